"""Nearest neighbours by randomly rotated one-bit codes (operator 7).

Every vector is scaled to length one and rotated by a fixed random orthogonal matrix; its code is
the sign of each coordinate, packed into 64-bit words, with one correction scalar: the inner
product of the vector with its own code's direction. For a query, rotated alike and quantised to
``QUERY_BITS`` bits a coordinate, the inner product with a code is a few AND and bit counts;
divided by the scalar it estimates the cosine without bias, with an error of at most
``epsilon`` standard deviations of a known size. Only vectors whose upper bound reaches the k-th
largest lower bound are reranked, by the exact cosine of the original vectors.

All vectors are coded, those of each length with a rotation of their own. Queries are a stated set,
searched in passes of ``PASS``: a pass's queries are broadcast (their number is fixed), each task scans
its vectors against some of them at a time and returns at most k per query, and these few rows
meet per query. Passes append to one folder, so no plan grows with their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved, shared_folder

PASS = 1 << 15
EPSILON, QUERY_BITS, SEED = 3.0, 4, 20240229
_ROWS = 4096  # vectors estimated at once
_QUERIES = 256


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix over the dimensions padded to whole 64-bit words."""
    wide = -(-dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return q * np.sign(np.diag(r))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to components of about one: no cosine changes in any bit, and
    none overflows or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words) and correction scalars of the rows of ``x``."""
    wide = turn.shape[0]
    o = _unit(x) @ turn[:x.shape[1]]
    code = np.packbits(o > 0, axis=1, bitorder="little").view("<u8")
    return code, np.abs(o).sum(axis=1) / np.sqrt(wide)


def index(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, x, code, corr) of every usable row; ``row`` numbers the rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors
    of any length do; rows that share an id are rows of their own.
    """
    spark = prepare(vectors.sparkSession)
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).filter(
        x.isNotNull() & F.expr(
            "forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(x, v -> v <> 0)"))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            xs = [np.array(v) for v in b.column(2).to_pylist()]
            codes, corr = [b""] * len(xs), np.zeros(len(xs))
            size = np.array([len(v) for v in xs])
            for d in set(size.tolist()):
                at = np.flatnonzero(size == d)
                if d not in turns:
                    turns[d] = rotation(d)
                code, corr[at] = encode(np.stack([xs[i] for i in at]), turns[d])
                for i, c in zip(at, code):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(corr)],
                                             ["row", "vec_id", "x", "code", "corr"])

    # every core works on a share of the vectors
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return saved(rows.repartition(n, "row").mapInArrow(
        run, "row long, vec_id long, x array<double>, code binary, corr double"))


def _quantised(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of each query's coordinates (query, plane, word), with offset, step and sum."""
    lo, hi = q.min(axis=1), q.max(axis=1)
    step = np.maximum((hi - lo) / ((1 << QUERY_BITS) - 1), 1e-300)
    level = np.rint((q - lo[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(level >> j & 1, axis=1, bitorder="little").view("<u8")
                       for j in range(QUERY_BITS)], axis=1)
    return planes, lo, step, level.sum(axis=1, dtype=np.int64)


def estimate(code: np.ndarray, corr: np.ndarray, planes: np.ndarray, lo: np.ndarray, step: np.ndarray,
             total: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (query, vector) and their error bounds."""
    wide = code.shape[1] * 64
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    dot = np.zeros((len(planes), len(code)), np.int64)
    for j in range(planes.shape[1]):
        for w in range(code.shape[1]):
            dot += np.bitwise_count(planes[:, j, w, None] & code[None, :, w]).astype(np.int64) << j
    # sum over coordinates of sign * query, from lo + step * level with signs 2 bit - 1
    signed = step[:, None] * (2 * dot - total[:, None]) + lo[:, None] * (2 * ones - wide)[None, :]
    root = np.sqrt(wide)
    safe = np.maximum(corr, 1e-12)[None, :]
    spread = np.sqrt(np.maximum(1 - corr ** 2, 0)) / np.sqrt(wide - 1)
    rounding = step[:, None] / np.sqrt(12.0)
    return signed / root / safe, epsilon * (spread[None, :] + rounding) / safe


class _Block:
    """Some queries of one length: scaled vectors, their lengths, and rotated bit planes."""

    def __init__(self, rows: list, turn: np.ndarray):
        self.rows = [r for r, _ in rows]
        self.x = _scaled(np.array([x for _, x in rows]))
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.planes, self.lo, self.step, self.total = _quantised(_unit(self.x) @ turn[:self.x.shape[1]])


def _search(vectors: DataFrame, asked: list, k: int, epsilon: float) -> DataFrame:
    """At most k (query, row, vec_id, score) per query and task; ``asked``: (row, x) of the queries."""
    by_size: dict[int, list] = {}
    for row, x in asked:
        by_size.setdefault(len(x), []).append((row, x))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {d: [_Block(of[at:at + _QUERIES], rotation(d)) for at in range(0, len(of), _QUERIES)]
                  for d, of in shared.value.items()}
        best: dict[int, list[tuple]] = {r: [] for of in shared.value.values() for r, _ in of}  # (-score, no id, id, row)
        for b in batches:
            size = b.column(2).value_lengths().to_numpy()
            for d in sorted(set(size.tolist()) & set(blocks)):
                whole = b.filter(pa.array(size == d))
                for at in range(0, whole.num_rows, _ROWS):
                    _scan(whole.slice(at, _ROWS), blocks[d], best, k, epsilon)
        found = [(q, r, None if no else v, -s) for q, top in best.items() for s, no, v, r in top]
        cols = list(zip(*found)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], ["query", "row", "vec_id", "score"])

    return vectors.mapInArrow(run, _FOUND)


_FOUND = "query long, row long, vec_id long, score double"


def _scan(part: pa.RecordBatch, blocks: list[_Block], best: dict[int, list[tuple]], k: int, epsilon: float) -> None:
    """Take the rows of ``part``, vectors of one length, into the best of the queries of ``blocks``."""
    row, ids = part.column(0).to_numpy(), part.column(1).to_pylist()
    x = _scaled(np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1))
    code = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(part.num_rows, -1)
    norm, corr = np.sqrt((x * x).sum(axis=1)), part.column(4).to_numpy()
    for q in blocks:
        est, err = estimate(code, corr, q.planes, q.lo, q.step, q.total, epsilon)
        own = row[None, :] == np.array(q.rows)[:, None]
        low = np.where(own, -np.inf, est - err)
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q.rows), -np.inf)
        floor = np.maximum(floor, [-best[r][-1][0] if len(best[r]) == k else -np.inf for r in q.rows])
        which, cand = np.nonzero((est + err >= floor[:, None]) & ~own)
        cut = np.searchsorted(which, np.arange(len(q.rows) + 1))
        for i, r in enumerate(q.rows):
            c = cand[cut[i]:cut[i + 1]]
            if len(c):
                exact = (x[c] * q.x[i]).sum(axis=1) / (norm[c] * q.norm[i])
                if len(c) > k:  # ties at the k-th place stay in
                    stay = exact >= np.partition(exact, len(c) - k)[-k]
                    c, exact = c[stay], exact[stay]
                best[r] = sorted([*best[r], *((-s, ids[j] is None, ids[j] or 0, int(row[j]))
                                              for s, j in zip(exact.tolist(), c.tolist()))])[:k]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            epsilon: float = EPSILON, at_once: int = PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of every query row.

    ``is_query`` chooses the queries by ``vec_id``. Candidates are all other rows with a vector of the
    query's length, those of the same id too; ties go to the smaller id (null ids last, then by place
    in the table). Rows that share an id are queries of their own. A query with fewer candidates
    gets them all; one that takes no part (see ``index``) gets none; an empty table gives no rows;
    other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x"))
    coded = index(src, "vec_id", "x")
    asked = coded.filter(F.coalesce(is_query, F.lit(False)))
    folder, block = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}", []

    def scan() -> None:
        if block:
            _search(coded, block, k, epsilon).write.mode("append").parquet(folder)
            block.clear()

    none = True
    for r in asked.select("row", "x").toLocalIterator():
        none = False
        block.append((r.row, r.x))
        if len(block) == at_once:
            scan()
    scan()
    if none:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return (spark.read.schema(_FOUND).parquet(folder).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            .join(names, "query").select("query_id", "rank", "vec_id", "score"))
