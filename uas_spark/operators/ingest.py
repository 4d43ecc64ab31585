"""Keyed ingest: idempotent append, atomic batches, unknown-sensor check, insert-if-absent
(M1-M6, G4).

Every operator returns DataFrames (accepted, rejected-with-reason) instead of status
codes. Per-batch decisions are partial aggregates (``groupBy(batch).agg``) joined back
to the rows, never a window over a whole batch, so a batch holding a third of all rows
is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_KEY = ["recorded_at", "report_id"]
# A batch of at most so many rows (a micro-batch, a client's retry) is looked up by its ids.
LOOKUP_ROWS = 1000


def first_arrival(batch: DataFrame, key: list[str], arrival: list) -> DataFrame:
    """Keep the first row per key in arrival order (later copies are retries). A partial
    aggregate: a key sent a million times is combined before the shuffle."""
    rest = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_r"))
    return first.select(*key, "_r.*").select(*batch.columns)


def touched_days(stored: DataFrame, batch: DataFrame, partition_col: str, ts_col: str) -> DataFrame:
    """The partitions of ``stored`` that hold a date of ``batch``. The batch's distinct dates (a
    small aggregate, bounded by the calendar) become a literal filter on the partition column,
    so the other partitions' files are not listed for reading."""
    days = [r[0] for r in batch.select(F.to_date(F.col(ts_col))).distinct().collect() if r[0] is not None]
    return stored.filter(F.col(partition_col).isin(days)) if days else stored.filter(F.lit(False))


def touched(stored: DataFrame, batch: DataFrame, partition_col: str, ts_col: str, id_col: str,
            most: int = LOOKUP_ROWS) -> DataFrame:
    """The rows of ``stored`` that can share a key with ``batch``: of its dates and, where it has at most
    ``most`` rows, of its ids. Those are literal filters, so the scan skips the other partitions, and the
    row groups whose Bloom filter (``sinks.append_time_partitioned``) has none of the ids; the join that
    follows is exact either way. At most ``most + 1`` rows come to the driver."""
    few = batch.select(F.to_date(F.col(ts_col)), F.col(id_col)).head(most + 1)
    if len(few) > most:
        return touched_days(stored, batch, partition_col, ts_col)
    days, ids = ({r[k] for r in few if r[k] is not None} for k in (0, 1))
    if not days or not ids:
        return stored.filter(F.lit(False))
    return stored.filter(F.col(partition_col).isin(list(days)) & F.col(id_col).isin(sorted(ids)))


def dedup_append(stored: DataFrame, batch: DataFrame, key: list[str] = POSITION_KEY,
                 arrival: list | None = None, ts_col: str = "recorded_at",
                 partition_col: str = "recorded_date", id_col: str = "report_id") -> DataFrame:
    """M1/M2/M3: rows of ``batch`` whose key is neither stored nor earlier in the batch.

    ``arrival`` orders the batch (default: its columns). A ``stored`` table that is partitioned
    by ``partition_col`` is read in the batch's dates only (the key holds the instant, so an
    equal key lies in an equal partition), and for a small batch in the row groups that may hold
    its ids (``touched``).
    """
    new = first_arrival(batch, key, arrival or [F.col(c) for c in batch.columns])
    if partition_col in stored.columns:
        stored = (touched(stored, batch, partition_col, ts_col, id_col) if id_col in key
                  else touched_days(stored, batch, partition_col, ts_col))
    return new.join(stored.select(*key), key, "left_anti")


def atomic_batch(df: DataFrame, batch_col: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """M4: one bad row rejects its whole batch. Returns (rows of good batches, bad batches with
    the count of bad rows). An empty batch has no rows and so is a no-op."""
    flagged = df.withColumn("_ok", valid)
    verdict = flagged.groupBy(batch_col).agg(F.sum(F.when(~F.col("_ok"), 1).otherwise(0)).alias("bad_rows"))
    good = verdict.filter(F.col("bad_rows") == 0).select(batch_col)
    bad = verdict.filter(F.col("bad_rows") > 0)
    return flagged.join(good, batch_col, "left_semi").drop("_ok"), bad


def unknown_sensors(positions: DataFrame, sensors: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """M5: per batch, the distinct sensor ids that are not registered (batches with none are absent)."""
    used = positions.select(batch_col, "sensor_id").distinct()
    missing = used.join(sensors.select("sensor_id"), "sensor_id", "left_anti")
    return missing.groupBy(batch_col).agg(F.array_sort(F.collect_set("sensor_id")).alias("unknown_sensor_ids"))


def sensor_ingest(stored: DataFrame, batch: DataFrame, sensors: DataFrame, batch_col: str = "batch_id",
                  arrival: list | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: unknown-sensor check rejects whole batches, then idempotent append.

    Returns (new rows, rejected batches with ``reason`` and the unknown ids).
    """
    unk = unknown_sensors(batch, sensors, batch_col)
    ok = batch.join(unk.select(batch_col), batch_col, "left_anti")
    new = dedup_append(stored, ok, POSITION_KEY, arrival)
    rejected = unk.withColumn("reason", F.lit("unknown_sensor"))
    return new, rejected


def insert_if_absent(existing: DataFrame, requests: DataFrame, id_col: str, arrival: list) -> DataFrame:
    """M6: create with a caller-chosen id; an id already stored, or claimed by an earlier
    request of the batch, is a conflict. Returns requests with ``outcome`` in
    ('accepted', 'duplicate_id').

    The first claim per id is a partial aggregate (``min`` of the arrival key), not a window,
    so an id requested a million times is combined map-side. Only requests that share the first
    arrival key are ranked, by their other columns: exactly one of them gets the id.
    """
    r = requests.withColumn("_arr", F.struct(*arrival))
    first = r.groupBy(F.col(id_col).alias("_fid")).agg(F.min("_arr").alias("_first"))
    ex = existing.select(F.col(id_col).alias("_eid")).distinct()
    r = r.join(first, F.col(id_col) == F.col("_fid"), "left").join(ex, F.col(id_col) == F.col("_eid"), "left")
    r = r.withColumn("_tie", F.col("_arr") == F.col("_first")).withColumn("_row", F.xxhash64(*requests.columns))
    # the later requests of an id are spread by their hash; the ties of one id meet
    w = Window.partitionBy(id_col, "_tie", F.when(~F.col("_tie"), F.col("_row"))).orderBy("_row")
    won = F.col("_eid").isNull() & F.col("_tie") & (F.row_number().over(w) == 1)
    return r.withColumn("outcome", F.when(won, "accepted").otherwise("duplicate_id")).drop(
        "_arr", "_fid", "_first", "_eid", "_tie", "_row")


def distinct_missing(ids: DataFrame, id_col: str, found: DataFrame, found_col: str) -> DataFrame:
    """Unique ids minus found ids."""
    return (ids.select(F.col(id_col).alias("id")).distinct()
               .join(found.select(F.col(found_col).alias("id")), "id", "left_anti"))
