"""SimHash near-duplicates (operator 2).

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
Fingerprints link when they differ in few bits. Distinct fingerprints are embedded by the
number of ones in each short bit segment: differing in d bits moves that vector by at most d
in Manhattan distance, so the distance is a lower bound. A grid range join puts every
fingerprint into the unit-radius cells around its vector: two fingerprints share a cell exactly
if their vectors are within distance 2. The pairs of a cell are verified on bits. A cell with many
fingerprints is not paired but split on exact bit patterns, which is linear, so a dense ball of
near copies costs no more than a sparse one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_key, saved, text_bytes, unused
from .components import components

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 2
CELL_PAIRS = 16  # cells with more fingerprints are split
# even bit positions: the low bit of each two-bit segment
_LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 bytes; no words give 0, fewer than a shingle are one shingle."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly x20 and x09-x0D separate
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # blocks: a long text's bit matrix stays small
        ones += np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text (null: empty, fp 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], ["id", "fp"])

    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _cells(fp: str) -> str:
    """SQL array of the unit-radius grid cells around the per-segment bit counts of ``fp``.

    Segments are two bits wide; their counts 0..2 pack into two bits each, so a cell is one
    long. The vector is (hi AND lo, hi XOR lo); a step of one segment stays within 0..2.
    """
    v = (f"((({fp} & shiftrightunsigned({fp}, 1)) & {_LOW}L) * 2) "
         f"| (({fp} ^ shiftrightunsigned({fp}, 1)) & {_LOW}L)")
    v = v.replace("* 2)", "<< 1)")
    count = "(shiftrightunsigned(v, 2 * i) & 3L)"
    # counts 0 and 2 go to 1; count 1 goes to 0 and to 2
    step = (f"CASE WHEN {count} = 1L THEN array(v ^ (1L << (2 * i)), v ^ (3L << (2 * i))) "
            f"ELSE array((v & ~(3L << (2 * i))) | (1L << (2 * i))) END")
    return (f"flatten(transform(array({v}), v -> concat(array(v), "
            f"flatten(transform(sequence(0, 31), i -> {step})))))")


def links(fps: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Links (a, b) whose components are those of "differ in at most 2 bits".

    ``fps`` holds distinct longs (fp). Every two fingerprints of a cell are compared, if there are at
    most ``cell_pairs``. Those of larger cells are split: two differ in at most 2 bits exactly if some
    value is within one bit of both, so each is linked, over itself and its 64 one-bit neighbours,
    to the smallest of these cells' fingerprints that shares the neighbour.
    """
    at = fps.select("fp", F.explode(F.expr(_cells("fp"))).alias("cell"))
    crowded = at.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    near = saved(at.join(crowded, "cell"))
    few = near.filter(F.col("n") <= cell_pairs)
    pairs = (few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")), "cell")
             .filter("b < a AND bit_count(a ^ b) <= 2").select("a", "b"))
    dense = near.filter(F.col("n") > cell_pairs).select("fp").distinct()
    mid = dense.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ (1L << i)))")).alias("mid"))
    rep = mid.groupBy("mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi")
    stars = (mid.join(rep, "mid").filter("fp <> lo AND bit_count(fp ^ lo) <= 2")
             .select(F.col("fp").alias("a"), F.col("lo").alias("b")))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id reachable over
    links of at most 2 bits. Equal fingerprints are one node however many rows hold them. Null
    and empty texts have fingerprint zero and link like any other. Repeated rows give repeated
    rows; a null id keeps its row but never names a component with a non-null id in it; other
    columns are ignored; an empty table gives no rows.
    """
    fps = saved(fingerprints(docs, id_col, text_col, shingle_words))
    named = _components(fps)
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return (fps.join(named.join(low, "root").select("fp", "component_id"), "fp")
            .select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _components(fps: DataFrame) -> DataFrame:
    """(fp, first_id, root): the distinct fingerprints, their smallest id, and their component."""
    # each fingerprint makes some 50 cells: without a number of its own, this small table would be
    # gathered into a few large tasks
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = saved(fps.groupBy("fp").agg(F.min("id").alias("first_id")).repartition(n, "fp"))
    comp = components(links(first.select("fp")))
    return (first.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group left, columns unchanged: the one with the smallest id, of
    several texts under it the one whose hash is smallest; rows without an id come last.

    Rows are told apart by id and text, so rows that share an id are documents of their own and rows
    without an id are compared like any others. Of rows equal in both, one stays. Null and empty
    texts are one group; an empty table gives no rows.
    """
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"))
                       .alias("k"), F.col(text_col).alias("t"))
    fps = saved(fingerprints(rows, "k", "t"))
    named = _components(fps)
    lead = saved(named.groupBy("root").agg(F.min("first_id").alias("k")).select("k.key"))
    # rows equal in id and text: one of them
    n = fps.select("id.key").join(lead, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    key, rank = unused(docs, "__key"), unused(docs, "__rank")
    lead = saved(n.withColumnRenamed("key", key).withColumnRenamed("n", rank))
    mine = docs.withColumn(key, row_key(id_col, text_col))
    one = mine.join(lead.filter(F.col(rank) == 1).select(key), key, "left_semi")
    again = mine.join(lead.filter(F.col(rank) > 1).select(key), key, "left_semi")
    again = again.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(rank) == 1)
    return one.select(*docs.columns).unionByName(again.select(*docs.columns))
