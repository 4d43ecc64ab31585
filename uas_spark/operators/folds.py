"""Ordered folds over the rows of a key, streamed.

The rows of a key are sorted by Spark and read once; only the key's state is held, so a key with
many rows costs their number, not its square, and no array of them is ever built. What can be
settled by aggregates, or cut into parts that do not depend on each other, is settled before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], schema: str,
                 start: Callable[[tuple], object], step: Callable[[object, tuple], Iterable[tuple]],
                 end: Callable[[object], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """Rows of each key, in order, through ``step(state, row)``; ``start(row)`` makes the state from the
    key's first row, ``end(state)`` follows its last. Both give output rows of ``schema``."""
    at = [rows.columns.index(k) for k in keys]
    out_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = tuple(row[i] for i in at)
                if key != last:
                    if last is not None:
                        out.extend(end(state))
                    last, state = key, start(row)
                out.extend(step(state, row))
            yield batch(out)
        if last is not None:
            yield batch(list(end(state)))

    # by a struct: of the bare keys the adaptive planner drops this exchange where it takes a union's parts to
    # be dealt by them already, though it has joined their partitions otherwise by then
    return (rows.repartition(_partitions(rows), F.struct(*keys)).sortWithinPartitions(*keys, *order)
            .mapInArrow(run, out_schema))


# ------------------------------------------------------------------ windows of patches

def _tagged(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows dealt by (key, seq) into ranges, each with its range ``_pid`` and the number ``_idx`` of
    reset points of its key that the range holds up to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, idx = TaskContext.get().partitionId(), None, 0
        for b in batches:
            found = []
            for k, reset in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if k != last:
                    last, idx = k, 0
                idx += bool(reset)
                found.append(idx)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(found, pa.int64())],
                [*b.schema.names, "_pid", "_idx"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("_pid int, _idx long").fields])
    dealt = rows.repartitionByRange(_partitions(rows), key, seq).sortWithinPartitions(key, seq)
    return cut_lineage(dealt.mapInArrow(run, schema))


def window_checks(patches: DataFrame, base: DataFrame) -> DataFrame:
    """(_tid, _seq, _bad): whether a patch leaves a window that does not end after its start.

    ``patches``: _tid, _seq, _st, _en (null keeps what stands), _ok (whether nothing else refuses
    it); ``base``: _tid, _st0, _en0. A patch that is not bad and ok moves the window for those after
    it. One with both times does not depend on earlier ones: it is a reset point, if accepted, and
    opens a segment. Segments are folded apart, so one row's many patches spread over the tasks;
    patches with one time follow each other within a segment, holding the window alone.
    """
    ms = [F.unix_micros(c).alias(c) for c in ("_st", "_en")]
    rows = patches.select("_tid", F.col("_seq").cast("long").alias("_seq"), *ms, "_ok")
    rows = rows.filter("_st IS NOT NULL OR _en IS NOT NULL").withColumn(
        "_reset", F.coalesce(F.col("_en") > F.col("_st"), F.lit(False)) & F.col("_ok"))
    rows = _tagged(rows, "_tid", "_seq")
    # rows before the first reset of their range belong to the last one of an earlier range
    upto = rows.groupBy("_tid", "_pid").agg(F.max("_idx").alias("_n"))
    earlier = Window.partitionBy("_tid").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    upto = upto.withColumn("_open", F.last(F.when(F.col("_n") > 0, F.struct("_pid", F.col("_n").alias("_idx"))),
                                           ignorenulls=True).over(earlier)).select("_tid", "_pid", "_open")
    rows = rows.join(upto, ["_tid", "_pid"]).withColumn(
        "_open", F.when(F.col("_idx") > 0, F.struct("_pid", "_idx")).otherwise(F.col("_open")))
    first = base.select("_tid", F.unix_micros("_st0").alias("_st0"), F.unix_micros("_en0").alias("_en0"))
    rows = rows.join(first, "_tid").select(
        "_tid", F.coalesce(F.col("_open._pid"), F.lit(-1)).alias("_spid"),
        F.coalesce(F.col("_open._idx"), F.lit(0)).alias("_sidx"), "_seq", "_st", "_en", "_ok", "_st0", "_en0")

    def start(row: tuple) -> list:
        return [row[7], row[8]]

    def step(window: list, row: tuple) -> Iterator[tuple]:
        tid, _, _, seq, st, en, ok = row[:7]
        new = (window[0] if st is None else st, window[1] if en is None else en)
        bad = new[0] is not None and new[1] is not None and new[1] <= new[0]
        if ok and not bad:
            window[:] = new
        yield tid, seq, bad

    kind = patches.schema["_tid"].dataType.simpleString()
    return ordered_fold(rows, ["_tid", "_spid", "_sidx"], ["_seq"], f"_tid {kind}, _seq long, _bad boolean", start, step)
