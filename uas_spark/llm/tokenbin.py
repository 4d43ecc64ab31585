"""Token ids as flat binary files (operator 6).

A folder holds, for each partition p of the documents in ascending id order,

* ``p.bin``: token ids one after another, unsigned little-endian, 16 bits if the vocabulary
  fits in them, else 32;
* ``p.idx``: 64-bit little-endian offsets, one more than documents: document i of the partition
  has ids ``offsets[i]:offsets[i + 1]`` of ``p.bin``;
* ``p.ids``: the documents' 64-bit ids.

Readers map the files into memory. Where partition p starts in the whole sequence is the prefix
sum of the partitions before it. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_folder, text_bytes
from .tokens import END_ID, tokenizer_path, worker_encoder

NULL_ID = -(1 << 63)  # stands for a null document id in .ids


def local_folder(uri: str) -> str:
    """The mounted path of a ``file:`` URI or plain path."""
    p = urlparse(uri)
    if p.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a folder mounted on every machine, not {uri}")
    return unquote(p.path)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID) -> DataFrame:
    """Write all of ``docs`` and return (part, n_docs, n_tokens, width, base), one row per file set.

    Null texts are empty (they hold the end id alone). Ids are ordered ascending, null first;
    rows with the same id are ordered by text, so repeated rows are all written. Other columns
    are ignored; an empty table writes no documents. A task writes under a name of its own and
    renames at the end: repeated or lost attempts leave no half-written file.
    """
    spark = prepare(docs.sparkSession)
    folder = local_folder(folder)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, offset, n_docs = worker_encoder(tokenizer), 0, 0
        kind = "<u2" if max(enc.vocab_size - 1, end_id) < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        stem = os.path.join(folder, f"part-{part:06d}")
        mine = f"{stem}.{uuid.uuid4().hex}"
        with open(f"{mine}.bin", "wb") as tokens, open(f"{mine}.idx", "wb") as idx, open(f"{mine}.ids", "wb") as ids:
            idx.write(np.zeros(1, "<i8").tobytes())
            for b in batches:
                flat, at = enc.encode(b.column(1).to_pylist(), end_id)
                tokens.write(flat.astype(kind).tobytes())
                idx.write((at[1:] + offset).astype("<i8").tobytes())
                ids.write(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                offset += int(at[-1])
                n_docs += b.num_rows
        for end in ("bin", "idx", "ids"):
            os.replace(f"{mine}.{end}", f"{stem}.{end}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([offset]),
             pa.array([np.dtype(kind).itemsize], pa.int32())], ["part", "n_docs", "n_tokens", "width"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (src.repartitionByRange(n, "id", F.xxhash64("t")).sortWithinPartitions("id", "t")
            .mapInArrow(run, "part int, n_docs long, n_tokens long, width int").collect())
    base, out = 0, []
    for r in sorted(rows):  # one small row per partition
        out.append((*r, base))
        base += r.n_tokens
    return spark.createDataFrame(out, "part int, n_docs long, n_tokens long, width int, base long")


def read(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    folder = local_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if not r["n_docs"]:
                    continue
                stem = os.path.join(folder, f"part-{r['part']:06d}")
                at = np.memmap(f"{stem}.idx", "<i8", "r")
                doc = np.memmap(f"{stem}.ids", "<i8", "r")
                tokens = np.memmap(f"{stem}.bin", f"<u{r['width']}", "r") if r["n_tokens"] else np.empty(0, "<u4")
                for lo in range(0, r["n_docs"], 4096):
                    hi = min(lo + 4096, r["n_docs"])
                    some = np.asarray(tokens[at[lo]:at[hi]]).astype("<u4").view(np.uint8)
                    cut = (at[lo:hi + 1] - at[lo]) * 4
                    crc = [zlib.crc32(some[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    ids = np.array(doc[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=ids == NULL_ID), pa.array(r["base"] + np.array(at[lo:hi])),
                         pa.array(np.diff(at[lo:hi + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = parts.count()
    return (parts.repartition(max(n, 1), "part")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def encode_and_read_back(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark)
    return read(spark, folder, write(docs, folder, tokenizer or tokenizer_path()))
