"""Benchmark decontamination (operator 5): size-partitioned MinHash containment search.

An item leaks into a document if the document holds at least ``threshold`` of the item's
distinct five-word shingles. Comparing MinHash sketches of both sides fails here: a 40-word item
inside a 20,000-word document has a Jaccard similarity near zero. So the sketch is taken of the
small side only. Each of ``slots`` hash functions picks the minimum of the half of the item's shingles that the
fewest items share, so a phrase common to many items is no one's sample. A document that lacks at
most a fifth of the item's shingles holds at least three fifths of that half, and each pick with that
chance: it is missed with probability 0.4 ** slots at most (below 3e-10 for 24). Documents are
partitioned by powers of two of their shingle count, and an item is searched only in partitions
whose largest document could hold enough of it. Documents that hold a pick are the candidates; they
are verified by exact shingle containment, on the shingles' text.

The one pass over the documents keeps the shingles that a Bloom filter of all item shingles lets
through. The filter has a fixed number of bits, so the broadcast is bounded whatever the size of
the benchmark; a fuller filter only sends more shingles into the exact join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_key, saved, unused

WORDS, THRESHOLD, SLOTS = 5, 0.8, 24
FILTER_BITS = 1 << 24  # 2 MB
# ASCII characters other than letters and digits separate words; bytes of other characters don't
_SEPARATE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xFF51AFD7ED558CCD], "<u8")


def words_of(lowered: bytes) -> list[bytes]:
    return lowered.translate(_SEPARATE).split()


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A 64-bit value per shingle, for the filter only (equal shingles get equal values)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, "<u8")
    w = np.fromiter(map(zlib.crc32, words), "<u8", len(words))
    h = np.zeros(n, "<u8")
    for j in range(size):
        h = (h ^ (w[j:j + n] + np.uint64(j + 1))) * _ODD[j % 5]
        h ^= h >> np.uint64(29)
    return h


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) & m


def _shingles(docs: DataFrame, id_col: str, text_col: str, keep, size: int) -> DataFrame:
    """(id, n_shingles, shingle, h): distinct shingles per row that ``keep`` (a function of their
    64-bit values, or None for all) lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n_all, text, value = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                h = shingle_hashes(words, size)
                at = np.arange(len(h)) if keep is None else np.flatnonzero(keep(h))
                found = {b" ".join(words[k:k + size]): h[k] for k in at.tolist()}
                row += [i] * len(found)
                n_all += [len(h)] * len(found)
                text += found.keys()
                value += found.values()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(n_all, pa.int64()),
                 pa.array(text, pa.binary()), pa.array(np.array(value, "<u8").view("<i8"))],
                ["id", "n_shingles", "shingle", "h"])

    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"),
                      F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_shingles long, "
                               "shingle binary, h long")


def _filter_bits(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter bytes: bit positions are merged by Spark into at most bits / 64 words."""
    h = shingles.select("h").distinct()
    m = bits - 1
    at = h.selectExpr(f"explode(array(h & {m}L, shiftrightunsigned(h, 32) & {m}L)) p")
    words = at.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(1L << cast(p & 63 as int))").alias("m"))
    found = words.toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return out.view(np.uint8)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
          slots: int = SLOTS, size: int = WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(id, item_id, n_found, n_item, containment) for every document holding at least
    ``threshold`` of an item's distinct shingles.

    Words are runs of ASCII letters and digits and non-ASCII characters of the lower-cased text.
    Null and empty texts and texts of fewer than ``size`` words have no shingles: they match
    nothing. Repeated rows of an id count once (of different texts under one id, the shingles are
    pooled, in the size partition of the longest); rows with a null id are left out, as they
    can't be reported. Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = prepare(docs.sparkSession)
    of_items = _shingles(items.filter(F.col(item_col).isNotNull()), item_col, item_text, None, size)
    of_items = of_items.select(F.col("id").alias("item_id"), "shingle", "h").distinct()
    # the sketch: per slot the minimum of the less common half of the item's shingles
    held_by = of_items.groupBy("shingle").agg(F.count("*").alias("n_items"))
    total = of_items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n_items", F.xxhash64("shingle"), "shingle"))
    half = (of_items.join(held_by, "shingle").join(total, "item_id").withColumn("rank", rank)
            .filter(F.col("rank") * 2 <= F.col("n_item") + 1))
    slot = half.select("item_id", "n_item", "shingle", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    pick = (slot.groupBy("item_id", "n_item", "slot")
            .agg(F.min_by("shingle", F.struct(F.xxhash64("shingle", "slot"), "shingle")).alias("shingle"))
            .select("item_id", "n_item", "shingle").distinct()
            # the smallest partition in which a document can hold enough of the item
            .withColumn("least_class", F.expr(f"cast(floor(log2(greatest(ceil(n_item * {threshold} - 1e-9), 1))) as int)")))

    bits = spark.sparkContext.broadcast(_filter_bits(of_items, filter_bits))

    def keep(h: np.ndarray) -> np.ndarray:
        a, b = _positions(h, filter_bits)
        table = bits.value
        one = lambda p: (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (one(a) & one(b)).astype(bool)

    hits = _shingles(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, keep, size)
    hits = saved(hits.groupBy("id", "shingle").agg(F.max("n_shingles").alias("n"))  # repeated rows count once
                 .select("id", "shingle", F.expr("cast(floor(log2(n)) as int)").alias("class")))
    found = (hits.join(pick, "shingle").filter("class >= least_class").select("id", "item_id", "n_item").distinct())
    held = found.join(of_items.select("item_id", "shingle"), "item_id").join(hits.select("id", "shingle"), ["id", "shingle"])
    return (held.groupBy("id", "item_id", "n_item").agg(F.count("*").alias("n_found"))
            .filter(f"n_found >= n_item * {threshold} - 1e-9")
            .select("id", "item_id", "n_found", "n_item", (F.col("n_found") / F.col("n_item")).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged.

    Rows are told apart by id and text: rows that share an id are judged one by one, rows without an
    id like any others, repeated rows alike. Null and empty texts stay; an empty table, or one without items, gives
    back what it has.
    """
    key = unused(docs, "__key")
    named = docs.withColumn(key, row_key(id_col, text_col))
    bad = leaks(named, items, key, text_col, **kw).select(F.col("id").alias(key)).distinct()
    return named.join(bad, key, "left_anti").select(*docs.columns)
