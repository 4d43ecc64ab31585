"""Packing documents into training sequences (operator 9).

Lengths are whole numbers up to the capacity, so the instance is a histogram with at most
``capacity`` entries, however many documents there are. On it

1. Martello-Toth dominance reduction fixes, for the longest remaining piece, a set of at most
   three pieces that provably is part of some optimal packing: the piece alone if nothing fits
   beside it; with the largest fitting partner if that fills the sequence, or if no two pieces
   fit beside it, or if no three do and the partner is at least as long as any fitting pair; with the
   fullest pair that holds this partner, if no three fit and no pair between the two does. All
   pieces of equal length are fixed at once. What nothing dominates is left.
2. Best fit decreasing packs the rest, again many equal sequences at a time.

The plan says, for each length, which sequences its first, second, ... piece goes to. Pieces
find their place by their rank among the pieces of equal length: a rank within the partition
plus a prefix sum over partitions, so no length's pieces meet in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved, text_bytes
from .tokens import END_ID, tokenizer_path, worker_encoder

CAPACITY = 4096


class _Lengths:
    """Counts by length with the sorted list of lengths that are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def give(self, length: int, k: int) -> None:
        if length not in self.n:
            bisect.insort(self.order, length)
        self.n[length] = self.n.get(length, 0) + k

    def largest_within(self, room: int) -> int:
        """The longest length of at most ``room``; 0 if there is none."""
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else 0

    def smallest(self, k: int) -> int:
        """Sum of the ``k`` shortest pieces; a huge number if there are fewer."""
        total = 0
        for a in self.order[:k]:
            m = min(self.n[a], k)
            total, k = total + m * a, k - m
        return total if not k else 1 << 60

    def two_above(self, length: int, but: int) -> int:
        """Sum of the two shortest pieces longer than ``length``, without one piece of length ``but``; a
        huge number if there are fewer."""
        total, k = 0, 2
        for a in self.order[bisect.bisect_right(self.order, length):]:
            m = min(self.n[a] - (a == but), k)
            total, k = total + m * a, k - m
            if not k:
                return total
        return 1 << 60

    def best_pair(self, room: int) -> int:
        """Largest sum of two pieces of at most ``room``; 0 if no two fit."""
        best, lo, hi = 0, 0, len(self.order) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room:
                hi -= 1
                continue
            if lo != hi or self.n[a] > 1:
                best = max(best, a + b)
            lo += 1
        return best


def _reduce(left: _Lengths, capacity: int, plan: "_Plan") -> dict[int, int]:
    """Fix dominating sets of one, two or three pieces; returns the counts of the pieces that none was found for.

    A set dominates for j whatever else is packed, as long as its partner is the longest fitting
    one of all remaining pieces; so pieces passed over stay in as partners of shorter ones. Beside j
    and its longest partner i a third piece y is fixed if no three others fit with j, i and y
    are the fullest pair, and no two pieces between them in length fit.
    """
    j = left.largest_within(capacity)
    while j:
        room = capacity - j
        left.take(j, 1)  # the piece itself is not its own partner
        i, chosen = left.largest_within(room), None
        if not i:
            chosen = [j]
        elif i == room or left.smallest(2) > room:
            chosen = [j, i]
        elif left.smallest(3) > room:
            best = left.best_pair(room)
            left.take(i, 1)
            y = left.largest_within(room - i)
            left.give(i, 1)
            if i >= best:
                chosen = [j, i]
            elif y and i + y == best and left.two_above(y, i) > room:
                chosen = [j, i, y]
        left.give(j, 1)
        if chosen:
            # what holds for one set holds for its copies: fixing it takes only its own pieces away
            need = Counter(chosen)
            k = min(left.n[x] // m for x, m in need.items())
            for x, m in need.items():
                left.take(x, k * m)
            plan.new(chosen, k)
        if not chosen or len(chosen) == 1 or j not in left.n:
            j = left.largest_within(j - 1)
    return dict(left.n)


class _Plan:
    """Sequences in groups of equal content; per length the runs of places for its pieces."""

    def __init__(self, capacity: int):
        self.capacity, self.n_seq = capacity, 0
        self.used: dict[int, int] = {}  # places given out per length
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, per sequence, offset

    def _place(self, length: int, seq: int, n_seq: int, per: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, seq, per, offset))
        self.used[length] = rank + n_seq * per

    def new(self, lengths: list[int], n: int) -> int:
        seq, at = self.n_seq, 0
        self.n_seq += n
        for x in lengths:
            self._place(x, seq, n, 1, at)
            at += x
        return seq

    def best_fit(self, counts: dict[int, int]) -> None:
        """Best fit decreasing of ``counts`` into new sequences. A tightest sequence is filled
        with pieces of one length before the next one, as one piece at a time would do."""
        room: list[int] = []  # sorted rooms that some open sequence has
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

        def put(free: int, seq: int, n: int) -> None:
            if free and n:
                if free not in groups:
                    bisect.insort(room, free)
                groups.setdefault(free, []).append((seq, n))

        for length in sorted(counts, reverse=True):
            n = counts[length]
            while n:
                i = bisect.bisect_left(room, length)
                if i < len(room):
                    free = room[i]
                    seq, m = groups[free].pop()
                    if not groups[free]:
                        del groups[free]
                        room.pop(i)
                else:
                    free, seq, m = self.capacity, self.n_seq, -(-n // (self.capacity // length))
                    self.n_seq += m
                per = free // length
                full = min(m, n // per)
                if full:
                    self._place(length, seq, full, per, self.capacity - free)
                    put(free - per * length, seq, full)
                    n -= full * per
                if full < m and n and n < per:
                    self._place(length, seq + full, 1, n, self.capacity - free)
                    put(free - n * length, seq + full, 1)
                    n, full = 0, full + 1
                put(free, seq + full, m - full)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) and the number of
    sequences for pieces with ``counts`` by length (1..capacity)."""
    plan = _Plan(capacity)
    plan.best_fit(_reduce(_Lengths(counts), capacity, plan))
    return sorted(plan.runs), plan.n_seq


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                  text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) of every whole text's pieces.

    ``part`` and ``rank`` number the pieces of equal length: rank within one task's output.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            flat, at = enc.encode(b.column(1).to_pylist(), end_id)
            raw = flat.astype("<u4").view(np.uint8)
            n_pieces = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(b.num_rows), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            size = np.minimum(np.diff(at)[row] - start, capacity)
            lo = (at[:-1][row] + start) * 4
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * size).tolist())]
            # rank among equal lengths: earlier batches, then earlier pieces of this one
            by = np.argsort(size, kind="stable")
            _, first, n_equal = np.unique(size[by], return_index=True, return_counts=True)
            rank = np.empty(len(size), np.int64)
            rank[by] = np.arange(len(size)) - np.repeat(first, n_equal)
            rank += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(start), pa.array(size),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, "i4")), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, "
                               "length long, ids_crc32 long, part int, rank long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (length, part, rank, ...; other columns stay).

    ``rank`` numbers a part's pieces of equal length from 0. Only the histogram of lengths (at
    most ``capacity`` rows) comes to the driver; the plan that goes back holds a few runs for
    each length.
    """
    spark = prepare(pieces.sparkSession)
    per_part = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_packing(counts, capacity)
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        width = int(t[:, 1].max(initial=0)) + 1
        key = t[:, 0] * width + t[:, 1]  # by length, then first rank
        for b in batches:
            n = b.num_columns
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(key, size * width + np.minimum(rank, width - 1), side="right") - 1
            x = rank - t[at, 1]
            seq, off = t[at, 2] + x // t[at, 3], t[at, 4] + x % t[at, 3] * size
            keep = [c for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep]
                                             + [pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])
            assert n == len(keep) + 1

    ranked = (pieces.join(base, ["length", "part"]).withColumn("__rank", F.col("rank") + F.col("base"))
              .drop("rank", "base", "part"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Only documents longer than
    ``capacity`` are cut. Repeated rows and null ids are packed like any others; other columns
    are ignored; an empty table gives no rows.
    """
    pieces = saved(cut_documents(docs, tokenizer or tokenizer_path(), capacity, id_col, text_col, end_id))
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
