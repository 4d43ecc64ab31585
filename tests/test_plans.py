"""Plan shape tests: the physical plans we rely on at scale."""

from uas_spark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    df = QUERIES[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_spatial_joins_have_no_cartesian_product(spark):
    for key in ["join_positions_zone_current", "join_positions_forecast_zone", "join_positions_covering_auth",
                "join_boxes_flight_plans", "sensor_coverage", "zone_observed_at_point", "auth_intersecting"]:
        p = _plan(spark, key)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def test_latest_uses_window_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = QUERIES["zone_latest_fresh"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from uas_spark.operators import asof, listings
    from uas_spark.sources import fixtures as fx
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plan texts in full
    fx.observed_reports(spark, SF).write.parquet(str(tmp_path / "zones"))
    zones = spark.read.parquet(str(tmp_path / "zones"))
    out = asof.zone_latest_fresh(zones, "2024-01-20 12:00:00", 30).select("zone_id", "report_id")
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(recorded_at" in p and "rings" not in p.split("ReadSchema")[1].split("\n")[0]
    hist = listings.history(zones, "zone_id", key="Z-1", from_ts="2024-01-10 00:00:00")
    p = hist._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(zone_id,Z-1)" in p and "GreaterThanOrEqual(recorded_at" in p
