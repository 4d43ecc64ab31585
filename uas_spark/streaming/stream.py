"""Structured Streaming forms of the ingest and "current state" operators (ST1-ST4).

The reference has no stream processor: clients POST small batches with safe retries. Here a
stream of JSON-lines bodies is micro-batched; each micro-batch runs the same batch operators.
Sinks are parquet folders given by the caller, normally under the cluster's shared
``spark.checkpoint.dir``; stream checkpoints go there too, so a restarted query resumes where it
stopped. What a micro-batch writes is either keyed by an anti-join or goes to a folder of its
own that a replay overwrites. What must be remembered is streaming state bounded by a watermark, or a
table of which a micro-batch reads the part it touches; no micro-batch reads all earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import asof, ingest
from ..operators.validate import coordinates_ok
from ..session import cut_lineage
from ..sources import json_sources as js
from ..sources.sinks import append_time_partitioned, replace_partitions, write_batch

POSITION_COLS = ["report_id", "drone_serial_number", "recorded_at", "latitude", "longitude", "altitude_ft"]
POSITION_SCHEMA = ("report_id string, drone_serial_number string, recorded_at timestamp, latitude double, "
                   "longitude double, altitude_ft double, recorded_date date")


def _bodies(spark: SparkSession, source: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema("serial string, body string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(source)


def _reports(bodies: DataFrame) -> DataFrame:
    """The one or many reports of each body, with their place in it."""
    items = bodies.select("*", F.posexplode_outer(js.one_or_many(F.col("body"), js.POSITION_BODY)).alias("pos", "r"))
    keep = [c for c in bodies.columns if c not in ("serial", "body")]
    return items.select(*keep, "pos", F.col("r.reportId").alias("report_id"),
                        F.col("serial").alias("drone_serial_number"),
                        js.to_instant(F.col("r.recordedAt")).alias("recorded_at"),
                        F.col("r.latitude").alias("latitude"), F.col("r.longitude").alias("longitude"),
                        F.col("r.altitudeFt").alias("altitude_ft"))


def position_stream(spark: SparkSession, source: str, files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a stream: bodies ``{serial, body}`` per line; one-or-many reports per body."""
    return _reports(_bodies(spark, source, files_per_trigger)).filter("report_id IS NOT NULL").select(*POSITION_COLS)


def _stored(spark: SparkSession, table: str, schema: str = POSITION_SCHEMA) -> DataFrame:
    """The table as stored so far; its columns without rows before the first append."""
    fs, path = _hadoop(spark, table)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(table)


def stream_ingest_positions(spark: SparkSession, source: str, table: str, checkpoint: str, rejects: str | None = None,
                            files_per_trigger: int | None = None):
    """ST1: continuous S1 -> validate -> M4 -> M1 into a table partitioned by ``recorded_date``.

    A body with one bad report is rejected whole; with ``rejects`` given, rejected bodies go
    there with their count of bad reports. Of two reports with one key the first in the body,
    and the first body of the micro-batch, stays. The anti-join reads the stored partitions of
    the micro-batch's dates only, so a replayed micro-batch appends nothing twice. Returns the
    started query.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        bodies = batch.withColumn("line", F.monotonically_increasing_id()).persist()
        # parsed once; the accepted rows are read for their dates, their ids and the append
        reports = _reports(bodies).filter("pos IS NOT NULL OR report_id IS NOT NULL").persist()
        good, bad = ingest.atomic_batch(
            reports, "line", F.coalesce(coordinates_ok(F.col("latitude"), F.col("longitude")), F.lit(False))
            & F.col("recorded_at").isNotNull() & F.col("report_id").isNotNull())
        good = good.persist()
        try:
            new = ingest.dedup_append(_stored(batch.sparkSession, table), good, arrival=[F.col("line"), F.col("pos")])
            append_time_partitioned(new.select(*POSITION_COLS), table)
            if rejects:
                (bodies.join(bad, "line").select("serial", "body", F.col("bad_rows").alias("n_bad"))
                 .write.mode("overwrite").json(f"{rejects}/batch={batch_id}"))
        finally:
            for df in (good, reports, bodies):
                df.unpersist()

    return (_bodies(spark, source, files_per_trigger).writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_dedup_bounded(spark: SparkSession, source: str, table: str, checkpoint: str, delay: str = "1 hour",
                         files_per_trigger: int | None = None):
    """ST2, reports on time: idempotent append with state bounded by ``delay``, without reading the table.

    A report is on time if it is newer than the newest of the micro-batches before, less ``delay``.
    The keys of that stretch are the stream's state; a retry meets its key there. Later reports are
    dropped here: ``stream_late_reports``, run on the same source after this query, stores them.
    Each micro-batch writes partitions of its own, so a replay is harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, table, f"on-time-{batch_id}")

    return (position_stream(spark, source, files_per_trigger).filter("recorded_at IS NOT NULL")
            .withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["recorded_at", "report_id"])
            .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_late_reports(spark: SparkSession, source: str, table: str, checkpoint: str, delay: str = "1 hour",
                        files_per_trigger: int | None = None):
    """ST2, late reports: what the watermark of ``stream_dedup_bounded`` dropped, or will drop, is
    stored once. Run it on the same source when that query has run.

    Whatever that query dropped is not newer than the table's newest report less ``delay`` (both cut to
    the millisecond, as the watermark is). Those reports, few in a live stream, are compared with the
    stored partitions of their own dates; the others are not looked at.
    """
    newest = _newest(spark, table)
    # a watermark counts whole milliseconds and drops what equals it
    limit = None if newest is None else F.timestamp_millis(F.unix_millis(F.lit(newest))) - F.expr(f"INTERVAL {delay}")

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"late-{batch_id}"
        rows = (batch.filter("false") if limit is None else batch.filter(F.col("recorded_at") <= limit)).persist()
        try:
            if not rows.isEmpty():
                stored = _stored(batch.sparkSession, table, POSITION_SCHEMA + ", part string").filter(F.col("part") != part)
                new = cut_lineage(ingest.dedup_append(stored, rows))
                write_batch(new, table, part)
        finally:
            rows.unpersist()

    return (position_stream(spark, source, files_per_trigger).filter("recorded_at IS NOT NULL")
            .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _newest(spark: SparkSession, table: str):
    """Instant of the newest report on time: only the newest date's partition is read."""
    stored = _stored(spark, table, POSITION_SCHEMA + ", part string").filter(F.col("part").startswith("on-time"))
    day = stored.select(F.max("recorded_date")).first()[0]
    return None if day is None else stored.filter(F.col("recorded_date") == day).select(F.max("recorded_at")).first()[0]


SLOTS = 64


def stream_latest_position(spark: SparkSession, source: str, snapshot: str, checkpoint: str,
                           files_per_trigger: int | None = None, slots: int = SLOTS):
    """ST3: keep T1 current as a keyed table of ``slots`` slices by drone.

    A micro-batch reads the slices that its drones fall into, merges its newest report per drone and
    replaces them (S11); the versions they replace are removed afterwards, so the table's size follows
    the drones, not the micro-batches. A version holds true reports only and the newest wins on
    reading, so a replay, or a failure between the two steps, changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        newest = asof.latest_position(batch).withColumn("slot", F.pmod(F.xxhash64("drone_serial_number"), F.lit(slots)).cast("int"))
        newest = cut_lineage(newest)
        touched = [r.slot for r in newest.select("slot").distinct().collect()]  # at most ``slots``
        if not touched:
            return
        old = _versions(spark_, snapshot).filter(F.col("slot").isin(touched))
        rows = asof.latest_position(newest.select(*POSITION_COLS, "slot").unionByName(old.select(*POSITION_COLS, "slot")))
        replace_partitions(cut_lineage(rows.withColumn("version", F.lit(batch_id))), snapshot, "slot", "version")
        for slot in touched:
            _remove_others(spark_, f"{snapshot}/slot={slot}", f"version={batch_id}")

    return (position_stream(spark, source, files_per_trigger).writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove_others(spark: SparkSession, folder: str, keep: str) -> None:
    """Remove the subfolders of ``folder`` but ``keep``."""
    fs, p = _hadoop(spark, folder)
    for f in fs.listStatus(p):
        if f.getPath().getName() != keep:
            fs.delete(f.getPath(), True)


def _versions(spark: SparkSession, snapshot: str) -> DataFrame:
    schema = POSITION_SCHEMA.replace(", recorded_date date", "") + ", slot int, version long"
    fs, p = _hadoop(spark, snapshot)
    return spark.read.schema(schema).parquet(snapshot) if fs.exists(p) else spark.createDataFrame([], schema)


def latest_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """T1 as ``stream_latest_position`` keeps it: one row per drone."""
    return asof.latest_position(_versions(spark, snapshot).drop("slot", "version"))


ZONE_CHANGE = "zone_id string, change string, report_id string, recorded_at timestamp"


def stream_zone_staleness(spark: SparkSession, source: str, sink: str, checkpoint: str, stale_minutes: int = 30,
                          files_per_trigger: int | None = None):
    """ST4: T2 as a continuous view: a row whenever a zone's fresh report changes.

    The clock is the stream's own: the newest report of the micro-batches so far. A zone's newest report
    is keyed state with a timer; it fires when the clock has left the report ``stale_minutes``
    behind, whether or not the zone reports again. ``change`` is 'enter', 'update' or 'leave', with the
    report that came or went stale; a micro-batch writes at most one row per zone to its own ``batch_id``,
    which a replay overwrites, and reads nothing but its rows. Reports that are stale on arrival are
    dropped. The state is in the checkpoint, so a restart goes on where it stopped.
    """
    reader = spark.readStream.schema("report_id string, zone_id string, recorded_at timestamp")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(change: str, at: int, rid: str) -> pd.DataFrame:
            return pd.DataFrame({"zone_id": [key[0]], "change": [change], "report_id": [rid],
                                 "recorded_at": [pd.Timestamp(at, unit="us", tz="UTC")]})

        if state.hasTimedOut:
            at, rid = state.get
            state.remove()
            yield row("leave", at, rid)
            return
        held = state.get if state.exists else None
        best = (-held[0], held[1]) if held else None
        for f in frames:
            for at, rid in zip(f["us"].tolist(), f["report_id"].tolist()):
                if best is None or (-at, rid) < best:
                    best = (-at, rid)
        if best is None:
            return
        at, rid = -best[0], best[1]
        # the timer fires once the watermark, which trails the clock by the stretch, has passed the report
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1))
        if held != (at, rid):
            state.update((at, rid))
            yield row("update" if held else "enter", at, rid)

    reports = (reader.json(source).filter("zone_id IS NOT NULL AND report_id IS NOT NULL AND recorded_at IS NOT NULL")
               .withWatermark("recorded_at", f"{int(stale_minutes)} minutes").withColumn("us", F.unix_micros("recorded_at")))
    changes = reports.groupBy("zone_id").applyInPandasWithState(
        step, ZONE_CHANGE, "at long, report_id string", "append", "EventTimeTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def zone_changes(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that ``stream_zone_staleness`` wrote so far, with ``batch_id``."""
    return spark.read.schema(ZONE_CHANGE + ", batch_id long").parquet(sink)


def zone_states(spark: SparkSession, sink: str) -> DataFrame:
    """The last change of every zone: those whose change is not 'leave' are fresh."""
    return asof.top1(zone_changes(spark, sink), ["zone_id"], [F.col("batch_id").desc()])
