"""Hard negatives by rotated one-bit codes with error intervals (operator 13).

A row's vector is made integer, scaled to length one and rotated by a fixed random orthogonal
matrix; its code is the sign of each coordinate, kept with its alignment, the inner product of
the unit vector with the code's direction. An anchor is rotated alike and split into a few bit
planes, so its inner product with a code is a sum of bit counts. The row is its alignment times
the code plus a residual at right angles to it, whose length follows from the alignment; by
Cauchy-Schwarz the residual adds at most its length times that of the anchor's part at right angles
to the code. This interval is certain, not probable: a row outside it can't have the score asked
for. Rows whose interval meets the wanted one, and reaches the k-th best score found so far, are
scored with integers.

Anchors are a stated set, searched in passes: a pass's anchors are broadcast (their number is fixed),
each task scans its rows against some of them at a time and keeps at most k per anchor (and
positive). Passes append to one folder, so no plan grows with their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved, shared_folder

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
PASS, PLANES, SEED = 1 << 15, 8, 20240711
_ROWS, _ANCHORS = 8192, 128  # rows and anchors estimated at once
_EXACT = float(1 << 53)
_SLACK = 1e-9  # relative rounding of the interval's own arithmetic
_MIN, _MAX, _HUGE = -(1 << 63), (1 << 63) - 1, 1e150


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix over the dimensions padded to whole 64-bit words."""
    wide = -(-max(dims, 1) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).standard_normal((wide, wide)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one (zero rows stay zero), and their lengths."""
    most = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    y = x / np.where(most > 0, most, 1)
    size = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / np.where(size > 0, size, 1), (size * most)[:, 0]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words), alignments and lengths of the rows of ``x``."""
    o, size = unit(x)
    o = o @ turn[:x.shape[1]]
    code = np.packbits(o > 0, axis=1, bitorder="little").view("<u8")
    return code, np.abs(o).sum(axis=1) / np.sqrt(turn.shape[0]), size


class Anchors:
    """A block of anchors of one length: integer vectors, and rotated unit vectors in bit planes."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        q, self.size = unit(x)
        q = q @ turn[:x.shape[1]]
        self.x = x
        self.lo = q.min(axis=1, initial=0.0)
        self.step = np.maximum((q.max(axis=1, initial=0.0) - self.lo) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((q - self.lo[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = level.sum(axis=1)
        self.planes = np.stack([np.packbits((level >> j & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
                                for j in range(PLANES)], axis=1)
        # length of what the planes leave out of the anchor
        self.left = np.sqrt(((self.lo[:, None] + self.step[:, None] * level - q) ** 2).sum(axis=1))

    def interval(self, code: np.ndarray, aligned: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible scores (anchor, row)."""
        wide = code.shape[1] * 64
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        dot = np.zeros((len(self.x), len(code)), np.int64)
        for j in range(PLANES):
            for w in range(code.shape[1]):
                dot += np.bitwise_count(self.planes[:, j, w, None] & code[None, :, w]).astype(np.int64) << j
        # inner product of the anchor with the code's direction, and how far it may be off
        along = (self.step[:, None] * (2 * dot - self.total[:, None])
                 + self.lo[:, None] * (2 * ones - wide)[None, :]) / np.sqrt(wide)
        off = self.left[:, None]
        across = np.sqrt(np.maximum(1 - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        middle = aligned[None, :] * along
        half = aligned[None, :] * off + np.sqrt(np.maximum(1 - aligned ** 2, 0))[None, :] * across + _SLACK
        # scores beyond a long end at its limits, and so do intervals
        scale = np.minimum(self.size, _HUGE)[:, None] * np.minimum(size, _HUGE)[None, :]
        return np.clip((middle - half) * scale, _MIN, _MAX), np.clip((middle + half) * scale, _MIN, _MAX)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of ``x`` with ``q``; beyond a long they end at its limits."""
    if len(x) == 0 or np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(x.shape[1], 1) < _EXACT:
        return (x @ q).astype(np.int64)  # every partial sum is a whole number that a double holds
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(v) * w for v, w in zip(r, whole)), _MIN), _MAX) for r in x], np.int64)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, x) of the rows that take part: no null label, no null or empty vector, no
    null or non-finite component. ``x`` is floor(scale * component), as doubles; ``row`` numbers the rows."""
    x = F.col("x")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("x"))
    src = src.filter(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.expr(
        "forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"))
    # floor without a detour over longs: components may be far larger than a long
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 1e15, F.floor(v * F.lit(float(scale))).cast("double"))
                        .otherwise(F.greatest(F.least(v, F.lit(1e300)), F.lit(-1e300)) * F.lit(float(scale))))
    return saved(src.withColumn("x", whole).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"))


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with code, alignment and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            xs = [np.array(v) for v in b.column(3).to_pylist()]
            codes: list = [None] * len(xs)
            aligned, size = np.zeros(len(xs)), np.zeros(len(xs))
            dims = np.array([len(v) for v in xs])
            for d in set(dims.tolist()):
                at = np.nonzero(dims == d)[0]
                turn = turns.setdefault(d, rotation(d))
                code, aligned[at], size[at] = encode(np.stack([xs[i] for i in at]), turn)
                for i, c in zip(at, code):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(aligned), pa.array(size)],
                                             ["row", "vec_id", "label", "x", "code", "aligned", "size"])

    return rows.mapInArrow(run, "row long, vec_id long, label long, x array<double>, code binary, aligned double, size double")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of one vector length at a time, some thousand: (dims, row, vec_id, label, x, code, aligned, size)."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def rows(d: int) -> tuple:
        p = pa.Table.from_batches(held.pop(d)).combine_chunks().to_batches()[0]
        return (d, p.column(0).to_numpy(), p.column(1).to_pylist(), p.column(2).to_numpy(),
                np.asarray(p.column(3).flatten()).reshape(p.num_rows, d),
                np.frombuffer(b"".join(p.column(4).to_pylist()), "<u8").reshape(p.num_rows, -1),
                p.column(5).to_numpy(), p.column(6).to_numpy())

    for b in batches:
        dims = b.column(3).value_lengths().to_numpy()
        for d in sorted(set(dims.tolist())):
            held.setdefault(d, []).append(b.filter(pa.array(dims == d)))
            if sum(p.num_rows for p in held[d]) >= _ROWS:
                yield rows(d)
    for d in list(held):
        yield rows(d)


_FOUND = "anchor_row long, positive long, low long, row long, vec_id long, score long"


def _scan(rows: DataFrame, asked: list, k: int, same: bool) -> DataFrame:
    """At most k rows per wanted entry and task, best first.

    ``asked``: (anchor_row, label, x, wanted); ``wanted`` is a list of (place, positive score), rows
    of another label and LOW to HIGH hundredths of the score are sought, or, for ``same``, one entry
    that takes any score of the same label.
    """
    by_dims: dict[int, list] = {}
    for a in asked:
        by_dims.setdefault(len(a[2]), []).append(a)
    shared = rows.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {d: [(Anchors(np.array([a[2] for a in of[at:at + _ANCHORS]]), rotation(d)), of[at:at + _ANCHORS])
                      for at in range(0, len(of), _ANCHORS)] for d, of in shared.value.items()}
        best: dict[tuple, list] = {}
        for d, row, ids, label, x, code, aligned, size in _groups(batches):
            for anchors, of in blocks.get(d, ()):
                least, most = anchors.interval(code, aligned, size)
                for i, (anchor, own, q, wanted) in enumerate(of):
                    fits = (label == own) & (row != anchor) if same else label != own
                    tops = [best.setdefault((anchor, place), []) for place, _ in wanted]
                    ranges = [(_MIN, _MAX) if same else (-(-LOW * p // 100), HIGH * p // 100) for _, p in wanted]
                    # what a row must be able to reach for some entry: its range, and its k-th best so far
                    bar = min(max(low, -top[-1][0]) if len(top) == k else low for (low, _), top in zip(ranges, tops))
                    c = np.flatnonzero(fits & (most[i] >= bar) & (least[i] <= max(high for _, high in ranges)))
                    if not len(c):
                        continue
                    s = scores(x[c], q)
                    for (low, high), top in zip(ranges, tops):
                        ok = np.flatnonzero((s >= low) & (s <= high))
                        if len(ok) > k:  # ties at the k-th place stay in
                            ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[-k]]
                        if len(ok):
                            top += [(-int(s[j]), ids[c[j]] is None, ids[c[j]] or 0, int(row[c[j]])) for j in ok]
                            top.sort()
                            del top[k:]
        wants = {(a[0], place): positive for of in shared.value.values() for a in of for place, positive in a[3]}
        out = [(a, place, wants[a, place], r, None if null else v, -s) for (a, place), top in best.items() for s, null, v, r in top]
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in _FOUND.split(", ")])

    return rows.mapInArrow(run, _FOUND)


def _passes(anchors: DataFrame, size: int) -> Iterator[list]:
    """Rows of ``anchors``, ``size`` at a time: so many are in the driver's memory at once."""
    block = []
    for r in anchors.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _searched(rows: DataFrame, asked: DataFrame, k: int, same: bool, at_once: int) -> DataFrame | None:
    """All passes' results, appended to one folder."""
    folder = None
    for rs in _passes(asked, at_once):
        found = _scan(rows, [(r.row, r.label, np.array(r.x), [(w.place, w.score) for w in r.wanted]) for r in rs], k, same)
        if folder is None:
            folder = f"{shared_folder(rows.sparkSession)}/negatives-{uuid.uuid4().hex}"
        found.write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(_FOUND).parquet(folder) if folder else None


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
         at_once: int = PASS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` chooses anchors by ``vec_id``. A score is the integer inner product of
    floor(scale * component); higher scores come first, ties by smaller id (null ids last, and
    then by place in the table). An anchor's positives are its first ``positives`` other rows of the same label;
    for each, the first ``negatives`` rows of another label with LOW to HIGH hundredths of the
    positive's score. Rows with a null label, a null or empty vector or a null or non-finite
    component take no part; vectors of different length have no score with one another. Rows that
    share an id are rows of their own, as anchors too. Scores beyond a long end at its limits.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = prepared(vectors, id_col, vec_col, label_col, scale)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = saved(_coded(rows.repartition(max(spark.sparkContext.defaultParallelism, n), "row")))
    anchors = coded.filter(F.coalesce(is_anchor, F.lit(False)))
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("score")))
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                     "negative_score long")
    near = _searched(coded, anchors.select("row", "label", "x", any_score.alias("wanted")), positives, True, at_once)
    if near is None:
        return none
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "row"]
    first = Window.partitionBy("anchor_row").orderBy(*order)
    near = saved(near.withColumn("place", F.row_number().over(first).cast("long")).filter(F.col("place") <= positives)
                 .select("anchor_row", "place", "vec_id", "score"))
    wanted = near.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("place", "score")).alias("wanted"))
    asked = coded.select("row", "label", "x").join(wanted, "row")
    far = _searched(coded, asked, negatives, False, max(at_once // positives, 1))
    if far is None:
        return none
    first = Window.partitionBy("anchor_row", "positive").orderBy(*order)
    far = far.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    named = near.select("anchor_row", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    ids = coded.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (far.join(named, ["anchor_row", "positive"]).join(ids, "anchor_row")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
