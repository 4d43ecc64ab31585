"""Registered streaming queries (ST1-ST4).

Each query writes the JSON-lines bodies Spark derives from the test tables into a new
folder under the session's shared checkpoint folder, runs the stream to completion
(``availableNow``), and returns the sink table. The oracle is the batch result the
stream must equal.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..streaming import stream as st
from .oracle_fixtures import iso, with_fixtures
from .registry import query


def _scratch(spark) -> str:
    """A new folder under the shared checkpoint folder (Spark creates it on first write)."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/streams/" + uuid.uuid4().hex


# Bodies of one source file: a task writes one file, so files grow in number, not in size.
SOURCE_ROWS = 100_000


def _position_source(spark, sf_dir, path: str, retries: bool, bad: bool = False) -> int:
    """Bodies {serial, body} in files of about ``SOURCE_ROWS``, four at least; a quarter of them (returned) makes
    a micro-batch, so that a stream meets them in several; odd events as one-element arrays. With ``retries`` every body is sent twice (a client retry,
    in another file). With ``bad``, the bodies of events ending in 5 also hold an impossible
    latitude."""
    e = fx.load(spark, sf_dir, "events")

    def item(latitude):
        return F.struct(F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("reportId"),
                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("recordedAt"),
                        latitude.alias("latitude"),
                        (F.lit(-123.0) + (F.col("event_id") * 7 % 1024).cast("double") / 1024.0).alias("longitude"),
                        F.col("value").alias("altitudeFt"))
    good = item(F.lit(47.0) + (F.col("event_id") % 512).cast("double") / 1024.0)
    body = F.when(F.col("event_id") % 2 == 1, F.to_json(F.array(good))).otherwise(F.to_json(good))
    if bad:
        body = F.when(F.col("event_id") % 10 == 5, F.to_json(F.array(good, item(F.lit(95.0))))).otherwise(body)
    b = e.select(F.concat(F.lit("SN-"), F.col("user_id").cast("string")).alias("serial"), body.alias("body"),
                 F.col("event_id").alias("k"))
    if retries:
        b = b.unionAll(b.withColumn("k", F.col("k") + 1))
    per = max(1, math.ceil(b.count() / 4 / SOURCE_ROWS))
    place = F.coalesce(F.pmod("k", F.lit(4 * per)), F.lit(0)).cast("int")
    b.repartitionById(4 * per, place).drop("k").write.mode("overwrite").json(path)
    return per


@query("stream_ingest_positions", with_fixtures("live_positions") + f"""
SELECT 'stored' AS kind, report_id, drone_serial_number, {iso('recorded_at')} AS recorded_at, CAST(0 AS BIGINT) AS n
FROM live_positions WHERE event_id % 10 <> 5
UNION ALL
SELECT 'rejected', NULL, drone_serial_number, NULL, 2 * count(*) FROM live_positions WHERE event_id % 10 = 5
GROUP BY drone_serial_number""")
def q_stream_ingest_positions(spark, sf_dir):
    """ST1 over several micro-batches, every body sent twice: the table ends with each report of
    the good bodies exactly once, and every body with a bad report is in the rejects."""
    d = _scratch(spark)
    per = _position_source(spark, sf_dir, os.path.join(d, "src"), retries=True, bad=True)
    q = st.stream_ingest_positions(spark, os.path.join(d, "src"), os.path.join(d, "table"), os.path.join(d, "ckpt"),
                                   os.path.join(d, "rejects"), files_per_trigger=per)
    q.awaitTermination()
    stored = spark.read.parquet(os.path.join(d, "table")).select(
        F.lit("stored").alias("kind"), "report_id", "drone_serial_number", "recorded_at", F.lit(0).cast("long").alias("n"))
    bad = spark.read.schema("serial string, body string, n_bad long, batch int").json(os.path.join(d, "rejects"))
    return stored.unionByName(bad.groupBy(F.col("serial").alias("drone_serial_number")).agg(F.count("*").alias("n"))
                              .select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("report_id"),
                                      "drone_serial_number", F.lit(None).cast("timestamp").alias("recorded_at"), "n"))


@query("stream_dedup_bounded", with_fixtures("live_positions") + """
SELECT report_id FROM live_positions""")
def q_stream_dedup_bounded(spark, sf_dir):
    """ST2 over several micro-batches: retries and most first reports come far later than the
    delay; the two queries together store each report once and lose none."""
    d = _scratch(spark)
    src, table = os.path.join(d, "src"), os.path.join(d, "table")
    per = _position_source(spark, sf_dir, src, retries=True)
    st.stream_dedup_bounded(spark, src, table, os.path.join(d, "ckpt"), "1 hour", files_per_trigger=per).awaitTermination()
    st.stream_late_reports(spark, src, table, os.path.join(d, "late"), "1 hour", files_per_trigger=per).awaitTermination()
    return spark.read.parquet(table).select("report_id")


@query("stream_latest_position", with_fixtures("live_positions") + f"""
SELECT drone_serial_number, report_id, {iso('recorded_at')} AS recorded_at
FROM (SELECT *, row_number() OVER (PARTITION BY drone_serial_number ORDER BY recorded_at DESC, report_id) rn
      FROM live_positions) WHERE rn = 1""")
def q_stream_latest_position(spark, sf_dir):
    """ST3: the latest positions kept current by several micro-batches in no order of time."""
    d = _scratch(spark)
    per = _position_source(spark, sf_dir, os.path.join(d, "src"), retries=False)
    q = st.stream_latest_position(spark, os.path.join(d, "src"), os.path.join(d, "snapshot"), os.path.join(d, "ckpt"),
                                  files_per_trigger=per)
    q.awaitTermination()
    return st.latest_snapshot(spark, os.path.join(d, "snapshot")).select("drone_serial_number", "report_id",
                                                                         "recorded_at")


@query("stream_zone_staleness", with_fixtures("observed_reports") + f""",
m AS (SELECT max(recorded_at) AS stamp FROM observed_reports)
SELECT zone_id, report_id, {iso('recorded_at')} AS recorded_at,
       CASE WHEN recorded_at >= m.stamp - INTERVAL 30 MINUTE THEN 'fresh' ELSE 'left' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn FROM observed_reports), m
WHERE rn = 1""")
def q_stream_zone_staleness(spark, sf_dir):
    """ST4 over micro-batches in the order of time: every zone's last report, and whether the zone is
    still fresh at the newest report of all or has left the view by its timer."""
    d = _scratch(spark)
    z = fx.observed_reports(spark, sf_dir).select("report_id", "zone_id", "recorded_at")
    src, sink, ckpt = (os.path.join(d, x) for x in ("src", "sink", "ckpt"))
    first, last = z.agg(F.min("recorded_at"), F.max("recorded_at")).first()
    for k in range(3):
        lo, hi = first + (last - first) * k / 3, first + (last - first) * (k + 1) / 3
        part = z.filter((F.col("recorded_at") >= F.lit(lo)) & ((F.col("recorded_at") < F.lit(hi)) if k < 2 else F.lit(True)))
        part.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(os.path.join(src, str(k)))
        # one run of the stream after each arrival: the state outlives the runs
        st.stream_zone_staleness(spark, os.path.join(src, "*"), sink, ckpt).awaitTermination()
    return st.zone_states(spark, sink).select("zone_id", "report_id", "recorded_at", F.when(
        F.col("change") == "leave", "left").otherwise("fresh").alias("state"))
