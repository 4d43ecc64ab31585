"""The wind layer: the zone operators (T2-T4, X1, X2, X11, F12, M3) over wind reports, and the
zone history as of an instant. The oracles are the visibility ones over the wind recipe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, ingest, listings, spatial
from ..sources import fixtures as fx
from . import oracle_fixtures as of
from . import registry_reads as reads
from . import registry_writes as writes  # noqa: F401  registers the oracles this module derives from
from .oracle_fixtures import iso, with_fixtures
from .registry import AT, FORECAST_AT, ORACLE, STAMP, _points, query

_COLS = ["zone_id", "report_id", "recorded_at", "state"]


def _wind(key: str) -> str:
    return ORACLE[key].replace(of.FIXTURES["zone_reports"][0], of.FIXTURES["wind_reports"][0]).replace(", ceiling_ft", "")


def _observed(spark, sf_dir):
    return fx.observed_reports(spark, sf_dir, "wind")


def _forecast(spark, sf_dir):
    return fx.forecast_reports(spark, sf_dir, "wind")


@query("wind_latest_fresh", _wind("zone_latest_fresh"))
def q_wind_latest_fresh(spark, sf_dir):
    return asof.zone_latest_fresh(_observed(spark, sf_dir), STAMP, 30).select(*_COLS)


@query("wind_asof", _wind("zone_asof"))
def q_wind_asof(spark, sf_dir):
    return asof.zone_asof(_observed(spark, sf_dir), AT).select(*_COLS)


@query("wind_forecast_nearest", _wind("zone_forecast_nearest"))
def q_wind_forecast_nearest(spark, sf_dir):
    return asof.zone_forecast_nearest(_forecast(spark, sf_dir), FORECAST_AT).select(*_COLS, "ingested_at")


@query("wind_observed_at_point", _wind("zone_observed_at_point"))
def q_wind_observed_at_point(spark, sf_dir):
    out = spatial.zone_observed_at_point(_observed(spark, sf_dir), _points(spark, sf_dir), at=AT)
    return out.select("probe_id", F.col("z_zone_id").alias("zone_id"), F.col("z_report_id").alias("report_id"),
                      F.col("z_state").alias("state"))


@query("wind_forecast_at_point", _wind("zone_forecast_at_point"))
def q_wind_forecast_at_point(spark, sf_dir):
    out = spatial.zone_forecast_at_point(_forecast(spark, sf_dir), _points(spark, sf_dir), FORECAST_AT)
    return out.select("probe_id", F.col("z_zone_id").alias("zone_id"), F.col("z_report_id").alias("report_id"))


@query("wind_observed_in_extent", _wind("zone_observed_in_extent"))
def q_wind_observed_in_extent(spark, sf_dir):
    boxes = reads._boxes(spark, sf_dir).select("box_id", "box")
    out = spatial.zone_observed_in_extent(_observed(spark, sf_dir), boxes, at="2024-01-20 12:00:00")
    return out.select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("wind_forecast_in_extent", _wind("zone_forecast_in_extent"))
def q_wind_forecast_in_extent(spark, sf_dir):
    boxes = reads._boxes(spark, sf_dir).select("box_id", "box")
    out = spatial.zone_forecast_in_extent(_forecast(spark, sf_dir), boxes, FORECAST_AT)
    return out.select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("dedup_append_wind", _wind("dedup_append_zone"))
def q_dedup_append_wind(spark, sf_dir):
    z = fx.zone_reports(spark, sf_dir, "wind")
    b = z.filter(F.col("ingested_at") >= F.to_timestamp(F.lit(fx.BATCH_FROM)))
    batch = b.withColumn("attempt", F.lit(0)).unionByName(b.withColumn("attempt", F.lit(1)))
    out = ingest.dedup_append(z.filter(F.col("ingested_at") < F.to_timestamp(F.lit(fx.STORED_BEFORE))), batch,
                              ["kind", "recorded_at", "report_id"], [F.col("attempt")])
    return out.select("kind", "report_id", "recorded_at", "zone_id")


@query("history_wind", _wind("history_zone"))
def q_history_wind(spark, sf_dir):
    z = fx.zone_reports(spark, sf_dir, "wind").withColumn("zk", F.concat_ws("/", "zone_id", "kind"))
    out = listings.history(z, "zk", keys=z.select("zk"), from_ts="2024-01-10 00:00:00", limit=50)
    return out.select("zone_id", "kind", "report_id", "recorded_at")


@query("history_zone_at", with_fixtures("observed_reports") + f"""
SELECT zone_id, report_id, {iso('recorded_at')} AS recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
  FROM observed_reports WHERE recorded_at <= TIMESTAMP '{AT}') WHERE rn = 1""")
def q_history_zone_at(spark, sf_dir):
    """F12 with ``at``: it overrides from, to and limit; the one report as of then, per zone."""
    z = fx.observed_reports(spark, sf_dir)
    out = listings.history(z, "zone_id", keys=z.select("zone_id"), from_ts="2024-01-25 00:00:00", limit=50, at=AT)
    return out.select("zone_id", "report_id", "recorded_at")
