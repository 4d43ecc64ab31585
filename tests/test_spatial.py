import datetime as dt
import random

from pyspark.sql import functions as F

from uas_spark.functions import geo
from uas_spark.operators import spatial

SQ = (-122.42, 47.61, -122.40, 47.63)


def _auths(spark):
    df = spark.createDataFrame([("a1", "o1", "approved", 400.0, dt.datetime(2026, 8, 1, 14), dt.datetime(2026, 8, 1, 18))],
                               "authorization_id string, owner_id string, status string, max_altitude_ft double, "
                               "start_time timestamp, end_time timestamp")
    return df.withColumn("area", geo.box_rings(*[F.lit(v) for v in SQ]))


def test_covering_hits_and_misses(spark):
    probes = spark.createDataFrame([
        ("hit", 47.62, -122.41, dt.datetime(2026, 8, 1, 15), 300.0),
        ("far", 10.0, 10.0, dt.datetime(2026, 8, 1, 15), 300.0),
        ("next_day", 47.62, -122.41, dt.datetime(2026, 8, 2, 15), 300.0),
        ("too_high", 47.62, -122.41, dt.datetime(2026, 8, 1, 15), 500.0)],
        "probe_id string, lat double, lon double, at timestamp, alt double")
    got = [r.probe_id for r in spatial.covering_authorizations(_auths(spark), probes, "at", "alt").collect()]
    assert got == ["hit"]


def test_intersecting_boxes_any_corner_order(spark):
    boxes = spark.createDataFrame([("b1", 47.7, -122.25, 47.55, -122.45), ("b2", 10.0, 10.0, 11.0, 11.0)],
                                  "box_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    boxes = boxes.withColumn("box", geo.normalize_box(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    got = [r.box_id for r in spatial.intersecting_authorizations(_auths(spark), boxes).collect()]
    assert got == ["b1"]


def _plans(spark):
    plans = spark.createDataFrame([
        ("fp-w", "waypoints", dt.datetime(2026, 8, 1, 14), dt.datetime(2026, 8, 1, 18), dt.datetime(2026, 1, 1), None),
        ("fp-p", "polygon", dt.datetime(2026, 8, 1, 14), dt.datetime(2026, 8, 1, 18), dt.datetime(2026, 1, 2), 250.0)],
        "flight_plan_id string, plan_type string, start_time timestamp, end_time timestamp, created_at timestamp, "
        "polygon_max_altitude_ft double")
    plans = plans.withColumn("polygon_area", F.when(F.col("plan_type") == "polygon", geo.box_rings(
        F.lit(-122.41), F.lit(47.61), F.lit(-122.40), F.lit(47.62))))
    wps = spark.createDataFrame([("fp-w", 0, 47.615, -122.415, 250.0, 350.0, 50.0),
                                 ("fp-w", 1, 47.62, -122.405, 300.0, 400.0, 50.0)],
                                "flight_plan_id string, sequence_number int, lat double, lon double, "
                                "altitude_min_ft double, altitude_max_ft double, radius_meters double")
    return plans, wps


def _box(spark, rows):
    df = spark.createDataFrame(rows, "box_id string, min_lat double, min_lon double, max_lat double, max_lon double, "
                                     "alt double")
    return df.select("box_id", "alt", geo.normalize_box(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"),
                                                        F.col("max_lon")).alias("box"))


def test_altitude_band_edges(spark):
    plans, wps = _plans(spark)
    wps = wps.filter(F.col("sequence_number") == 0)
    plans = plans.filter(F.col("plan_type") == "waypoints")
    rows = [(f"a{a}", 47.614, -122.416, 47.616, -122.414, a) for a in (250.0, 250.1, 350.0, 350.1)]
    got = sorted(r.box_id for r in spatial.intersecting_flight_plans(plans, wps, _box(spark, rows), "alt").collect())
    assert got == ["a250.1", "a350.0"]


def test_plan_shapes_and_radius(spark):
    plans, wps = _plans(spark)
    rows = [("tight", 47.6148, -122.4152, 47.6152, -122.4148, 200.0),
            ("far", 49.9, -122.42, 50.0, -122.41, 200.0)]
    got = sorted((r.box_id, r.flight_plan_id) for r in
                 spatial.intersecting_flight_plans(plans, wps, _box(spark, rows)).collect())
    assert got == [("tight", "fp-w")]
    rows = [("poly", 47.605, -122.415, 47.612, -122.405, 200.0)]
    got = [r.flight_plan_id for r in spatial.intersecting_flight_plans(plans, wps, _box(spark, rows), "alt").collect()]
    assert got == ["fp-p"]


def test_sensor_coverage_great_circle(spark):
    sensors = spark.createDataFrame([("s1", 47.63, -122.36, 5000.0)],
                                    "sensor_id string, latitude double, longitude double, sensing_radius_meters double")
    pos = spark.createDataFrame([("in", 47.66, -122.36), ("out", 47.68, -122.36)],
                                "report_id string, latitude double, longitude double")
    got = [r.report_id for r in spatial.sensor_coverage(sensors, pos).collect()]
    assert got == ["in"]


def test_sensor_coverage_at_the_antimeridian_and_the_poles(spark):
    sensors = spark.createDataFrame([("east", 10.0, 179.999, 5000.0), ("west", -20.0, -179.999, 5000.0),
                                     ("pole", 89.99, 0.0, 5000.0), ("all", -90.0, 50.0, 3000.0), ("off", 10.0, 0.0, 0.0)],
                                    "sensor_id string, latitude double, longitude double, sensing_radius_meters double")
    pos = spark.createDataFrame([("a", 10.0, -179.999), ("b", 10.0, 179.99), ("c", -20.0, 179.999), ("d", 89.99, 180.0),
                                 ("e", 89.99, 90.0), ("f", -89.99, -130.0), ("g", 10.0, 179.0), ("h", 10.0, 0.0),
                                 ("i", 10.0, 180.0), ("j", 10.0, -180.0)],
                                "report_id string, latitude double, longitude double")
    got = {(r.s_sensor_id, r.report_id) for r in spatial.sensor_coverage(sensors, pos).collect()}
    exp = {(s.sensor_id, p.report_id) for s in sensors.collect() for p in pos.collect()
           if s.sensing_radius_meters and _metres(s.latitude, s.longitude, p.latitude, p.longitude) <= s.sensing_radius_meters}
    assert got == exp and {("east", "a"), ("west", "c"), ("pole", "d"), ("all", "f")} <= got
    assert spatial.sensor_coverage(sensors, pos).count() == len(exp)


def _metres(a, b, c, d):
    import math
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


ZONES = "report_id string, zone_id string, state string, recorded_at timestamp, ingested_at timestamp, x double"


def _zones(spark, rows):
    df = spark.createDataFrame(rows, ZONES)
    return df.withColumn("rings", geo.box_rings(F.col("x"), F.lit(47.0), F.col("x") + 1, F.lit(48.0))).drop("x")


def test_one_report_id_at_two_instants(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    zones = _zones(spark, [("r", "z", "clear", t(1), t(1), -123.0), ("r", "z", "rainy", t(3), t(3), -120.0)])
    pos = spark.createDataFrame([("p1", dt.datetime(2026, 1, 1, 1, 30), 47.5, -122.5), ("p2", t(4), 47.5, -122.5), ("p3", t(4), 47.5, -119.5)],
                                "report_id string, recorded_at timestamp, latitude double, longitude double")
    for join in (spatial.join_positions_zone_current, spatial.join_positions_forecast_zone):
        got = sorted((r.report_id, r.z_state) for r in join(pos, zones).collect())
        assert got == [("p1", "clear"), ("p3", "rainy")], join
    boxes = spark.createDataFrame([("b", 47.2, -122.8, 47.4, -122.6)], "box_id string, a double, b double, c double, d double")
    boxes = boxes.select("box_id", geo.normalize_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    at = lambda h: f"2026-01-01 0{h}:00:00"
    for find in (lambda h: spatial.zone_observed_in_extent(zones, boxes, at=at(h)),
                 lambda h: spatial.zone_forecast_in_extent(zones, boxes, at(h))):
        assert [r.z_state for r in find(1).collect()] == ["clear"] and find(3).count() == 0


def test_wide_shapes_and_long_windows_stay_small(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    # one zone is quiet for years, one covers nearly the world
    zones = spark.createDataFrame([("a", "z1", "clear", t(2020), t(2020), -123.0, -122.0, 47.0, 48.0),
                                   ("b", "z2", "rainy", t(2024), t(2024), -179.0, 179.0, -89.0, 89.0)],
                                  ZONES.replace("x double", "x double, y double, u double, v double"))
    zones = zones.withColumn("rings", geo.box_rings(F.col("x"), F.col("u"), F.col("y"), F.col("v"))).drop("x", "y", "u", "v")
    pos = spark.createDataFrame([("p", t(2021), 47.5, -122.5), ("q", t(2025), 10.0, 10.0), ("o", t(1999), 47.5, -122.5)],
                                "report_id string, recorded_at timestamp, latitude double, longitude double")
    got = sorted((r.report_id, r.z_report_id) for r in spatial.join_positions_zone_current(pos, zones).collect())
    assert got == [("p", "a"), ("q", "b")]
    windows = spark.createDataFrame([(0, 3_000_000_000_000_000)], "a long, b long")
    n, levels = spatial.with_windows(windows, F.col("a"), F.col("b"), spatial.HOUR_US)
    assert n.count() <= spatial.BUCKETS


def test_world_sized_search_box(spark):
    auths = _auths(spark)
    boxes = spark.createDataFrame([("world", -89.0, -180.0, 89.0, 180.0), ("near", 47.6, -122.5, 47.7, -122.4),
                                   ("far", 0.0, 0.0, 1.0, 1.0)], "box_id string, a double, b double, c double, d double")
    boxes = boxes.select("box_id", geo.normalize_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    got = sorted(r.box_id for r in spatial.intersecting_authorizations(auths, boxes).collect())
    assert got == ["near", "world"]


def _first_join(df):
    """The keys of the join nearest to the result."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return next(line for line in plan.splitlines() if "Join Inner" in line)


def test_candidates_are_tested_where_they_meet(spark):
    probes = spark.createDataFrame([("hit", 47.62, -122.41, dt.datetime(2026, 8, 1, 15))],
                                   "probe_id string, lat double, lon double, at timestamp")
    boxes = _box(spark, [("b", 47.6, -122.5, 47.7, -122.4, 1.0)])
    slanted = _auths(spark).withColumn("area", F.expr("array(slice(area[0], 1, 3) || slice(area[0], 1, 1))"))
    for auths in (_auths(spark), slanted):
        points = spatial.covering_authorizations(auths, probes, "at")
        boxed = spatial.intersecting_authorizations(auths, boxes)
        for got in (points, boxed):  # no join of the candidate pairs with the shapes
            join = _first_join(got)
            assert "g_cx" in join and "a_authorization_id" not in join, join
        assert boxed.count() == 1
    many = _auths(spark).withColumn("area", F.expr(
        "array(slice(area[0], 1, 1) || transform(sequence(1, 20), i -> named_struct('lon', area[0][0].lon + i / 1100D, "
        "'lat', area[0][0].lat)) || slice(area[0], 3, 3))"))
    assert spatial.intersecting_authorizations(many, boxes).count() == 1


def test_sensor_cells_within_the_radius(spark):
    sensors = spark.createDataFrame([("s", 47.5, 179.99, 5000.0), ("t", 47.5, -122.5, 3000.0)],
                                    "sensor_id string, latitude double, longitude double, sensing_radius_meters double")
    rows = [(f"{i}-{j}-{x}", 47.45 + i / 200, x - 0.05 + j / 200) for i in range(21) for j in range(21) for x in (-122.5, -180.0, 179.99)]
    pos = spark.createDataFrame(rows, "report_id string, latitude double, longitude double")
    every = sensors.selectExpr("sensor_id", "latitude a", "longitude b", "sensing_radius_meters r").crossJoin(pos)
    want = every.filter(geo.haversine_m(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude")) <= F.col("r"))
    want = sorted((r.sensor_id, r.report_id) for r in want.filter("abs(longitude) <= 180").collect())
    got = sorted((r.s_sensor_id, r.report_id) for r in spatial.sensor_coverage(sensors, pos.filter("abs(longitude) <= 180")).collect())
    assert got == want and len(got) > 100


def test_buckets_follow_how_often_zones_report(spark):
    start = dt.datetime(2026, 8, 1)
    zones = spark.createDataFrame([(f"r{i}", "z", start + dt.timedelta(seconds=10 * i)) for i in range(360)],
                                  "report_id string, zone_id string, recorded_at timestamp")
    zones = zones.withColumn("state", F.lit("good")).withColumn("ingested_at", F.col("recorded_at"))
    zones = zones.withColumn("rings", geo.box_rings(*[F.lit(v) for v in SQ]))
    pos = spark.createDataFrame([(f"p{i}", start + dt.timedelta(seconds=10 * i + 5), 47.62, -122.41) for i in range(360)],
                                "report_id string, recorded_at timestamp, latitude double, longitude double")
    out = spatial.join_positions_zone_current(pos, zones)
    assert sorted((r.report_id, r.z_report_id) for r in out.collect()) == sorted((f"p{i}", f"r{i}") for i in range(360))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "1.0E7" in plan and "3.6E9" not in plan  # buckets of ten seconds, not of an hour


def _many_plans(spark, plans, discs, boxes):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    p = spark.createDataFrame([(i, "waypoints", None, None, t, t, t) for i in plans],
                              "flight_plan_id string, plan_type string, polygon_area array<array<struct<lon double, lat double>>>, "
                              "polygon_max_altitude_ft double, start_time timestamp, end_time timestamp, created_at timestamp")
    w = spark.createDataFrame([(i, k, la, lo, 0.0, 400.0, r) for k, (i, la, lo, r) in enumerate(discs)],
                              "flight_plan_id string, sequence_number int, lat double, lon double, altitude_min_ft double, "
                              "altitude_max_ft double, radius_meters double")
    b = spark.createDataFrame(boxes, "box_id string, a double, b double, c double, d double")
    return p, w, b.select("box_id", geo.normalize_box("a", "b", "c", "d").alias("box"))


def test_a_plan_whose_waypoints_meet_a_box_several_times_comes_once(spark):
    """Against all pairs: many waypoints, repeated and null ids, plans of several rows, a box as wide as the world."""
    rng = random.Random(5)
    plans = ["a", "b", "c", "d", "d", "e", None]
    discs = [(i, 47 + rng.random() / 8, 8 + rng.random() / 8, rng.choice([0.0, 50.0, 900.0, 4000.0]))
             for i, n in (("a", 9), ("b", 40), ("c", 3), ("d", 5), (None, 4)) for _ in range(n)]
    discs += [("e", 10.0, 179.99, 5000.0), ("e", 10.0, -179.99, 5000.0), ("e", None, 8.0, 100.0)]
    boxes = [(f"x{k}", la, lo, la + rng.random() / 20, lo + rng.random() / 20)
             for k in range(40) for la, lo in [(47 + rng.random() / 8, 8 + rng.random() / 8)]]
    boxes += [("world", -80.0, -180.0, 80.0, 180.0), (None, 47.0, 8.0, 47.1, 8.1), (None, 47.05, 8.0, 47.06, 8.2),
              ("x1", 47.0, 8.0, 47.2, 8.2)]
    p, w, b = _many_plans(spark, plans, discs, boxes)
    got = [(r.box_id, r.flight_plan_id) for r in spatial.intersecting_flight_plans(p, w, b).collect()]
    known = p.select(F.col("flight_plan_id").alias("_p")).filter("_p IS NOT NULL").distinct()
    j = w.join(known, F.col("flight_plan_id") == F.col("_p")).crossJoin(b)
    exact = geo.disc_box_intersects("lat", "lon", "radius_meters", F.col("box.min_lon"), F.col("box.min_lat"),
                                    F.col("box.max_lon"), F.col("box.max_lat"))
    exp = {(r.box_id, r.flight_plan_id) for r in j.filter(exact).collect()}
    assert len(got) == len(set(got)) and set(got) == exp and ("world", "e") in exp


def test_hits_of_a_plan_are_not_compared_after_the_join(spark):
    """no aggregate by (box, plan) stands above the join of boxes and discs."""
    p, w, b = _many_plans(spark, ["a"], [("a", 47.0, 8.0, 900.0), ("a", 47.001, 8.0, 900.0)], [("x", 47.0, 8.0, 47.1, 8.1)])
    out = spatial.intersecting_flight_plans(p, w, b)
    assert out.count() == 1
    assert "Aggregate [box_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_disc_surely_meets_only_if_it_meets(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(20000):
        la, lo, r = rng.uniform(-89.9, 89.9), rng.uniform(-180, 180), 10 ** rng.uniform(-3, 7.3)
        d = r / 111000 * rng.uniform(0.5, 1.5)
        y, x = la + d * rng.uniform(-1, 1), lo + d * rng.uniform(-1, 1)
        rows.append((la, lo, r, x, y, x + d * rng.random(), y + d * rng.random()))
    side = ["x0", "y0", "x1", "y1"]
    df = spark.createDataFrame(rows, "lat double, lon double, r double, x0 double, y0 double, x1 double, y1 double")
    n = df.select(geo.disc_surely_meets("lat", "lon", F.cos(F.radians("lat")), geo.disc_sure("lat", "r"), *side).alias("s"),
                  geo.disc_box_intersects("lat", "lon", "r", *side).alias("e")).groupBy("s", "e").count().collect()
    n = {(r.s, r.e): r["count"] for r in n}
    assert (True, False) not in n and n[True, True] > 2 * n[False, True]


def test_exploded_rows_are_never_broadcast(spark):
    """however small a side is taken to be, it is not gathered by the driver."""
    sensors = spark.createDataFrame([("s", 47.5, -122.5, 5000.0)],
                                    "sensor_id string, latitude double, longitude double, sensing_radius_meters double")
    pos = spark.createDataFrame([("p", 47.5, -122.5)], "report_id string, latitude double, longitude double")
    p, w, b = _many_plans(spark, ["a"], [("a", 47.0, 8.0, 900.0)], [("x", 47.0, 8.0, 47.1, 8.1)])
    probes = spark.createDataFrame([("hit", 47.62, -122.41, dt.datetime(2026, 8, 1, 15))],
                                   "probe_id string, lat double, lon double, at timestamp")
    for out in (spatial.sensor_coverage(sensors, pos), spatial.intersecting_flight_plans(p, w, b),
                spatial.covering_authorizations(_auths(spark), probes, "at")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [g_lvl" in line]
        assert joins and all("SortMergeJoin" in line for line in joins), plan
        assert out.count() == 1


def test_a_disc_goes_to_few_buckets_and_carries_no_more_than_needed(spark):
    """a window of half a day is a row or two, and what follows from a disc's centre and radius stays behind."""
    p, w, b = _many_plans(spark, ["a"], [("a", 47.0, 8.0, 900.0)], [("x", 47.0, 8.0, 47.1, 8.1), ("y", 47.01, 8.0, 47.1, 8.1)])
    p = p.withColumn("end_time", F.expr("start_time + INTERVAL 12 HOURS"))
    b = b.withColumn("at", F.to_timestamp(F.lit("2024-01-01 11:00:00")))
    out = spatial.intersecting_flight_plans(p, w, b, at_col="at")
    assert sorted(r.box_id for r in out.collect()) == ["x"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "_rivals" in line)
    assert "4.32E10" in plan and "1.08E10" not in plan and "_s_min_lat" not in join and "_cos" not in plan


def test_points_in_cells_with_and_without_edges(spark):
    """against all pairs; inside cells and rectangles are joined apart, without the test of edges."""
    from uas_spark.operators import covering
    rng = random.Random(3)

    def ring(n, x, y, r):
        import math
        pts = [(x + r * math.cos(6.283 * i / n) * rng.uniform(0.4, 1), y + r * math.sin(6.283 * i / n) * rng.uniform(0.4, 1))
               for i in range(n)]
        return [[*pts, pts[0]]]

    t = dt.datetime(2026, 8, 1)
    rows = [(f"a{i}", ring(n, 8 + rng.random() / 2, 47 + rng.random() / 2, rng.choice([0.02, 0.1, 0.4]))) for i, n in
            enumerate([3, 3, 3, 4, 5, 9, 30, 200])] + [("r", [[(8.1, 47.1), (8.3, 47.1), (8.3, 47.3), (8.1, 47.3), (8.1, 47.1)]])]
    auths = spark.createDataFrame(rows, "authorization_id string, area array<array<struct<lon double, lat double>>>")
    auths = auths.withColumn("start_time", F.lit(t)).withColumn("end_time", F.lit(t + dt.timedelta(hours=5)))
    pts = spark.createDataFrame([(k, 47 + rng.random() / 2, 8 + rng.random() / 2) for k in range(2000)],
                                "k int, lat double, lon double").withColumn("at", F.lit(t + dt.timedelta(hours=1)))
    r = "area"
    shapes = auths.select("authorization_id", F.expr(geo.bbox_sql(r)).alias("_sb"), F.expr(geo.edges_sql(r)).alias("_edges"))
    want = shapes.crossJoin(pts).filter(covering.polygon_holds_point("_edges", "_sb", "lon", "lat"))
    want = sorted((x.k, x.authorization_id) for x in want.collect())
    out = spatial.covering_authorizations(auths, pts, "at")
    assert sorted((x.k, x.a_authorization_id) for x in out.collect()) == want and len(want) > 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "g_cx" in line]
    assert len(joins) == 2 and sum("_edges" in line for line in joins) == 1
    plan = spatial.covering_authorizations(auths.filter("authorization_id = 'r'"), pts, "at")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "g_cx" in line for line in plan.splitlines()) == 1


def test_most_intervals_go_to_one_bucket_or_two(spark):
    """F8: buckets follow the longer intervals, not the middle one."""
    start, at, rows = dt.datetime(2026, 8, 1), 0, []
    for i in range(300):
        rows.append((f"r{i}", "z", start + dt.timedelta(seconds=at)))
        at += 40 if i % 3 == 0 else 10
    zones = spark.createDataFrame(rows, "report_id string, zone_id string, recorded_at timestamp")
    zones = zones.withColumn("state", F.lit("good")).withColumn("ingested_at", F.col("recorded_at"))
    zones = zones.withColumn("rings", geo.box_rings(*[F.lit(v) for v in SQ]))
    pos = zones.select(F.concat(F.lit("p"), "report_id").alias("report_id"), F.expr("recorded_at + INTERVAL 5 SECONDS").alias("recorded_at"),
                       F.lit(47.62).alias("latitude"), F.lit(-122.41).alias("longitude"))
    out = spatial.join_positions_zone_current(pos, zones)
    assert sorted((r.report_id, r.z_report_id) for r in out.collect()) == sorted((f"pr{i}", f"r{i}") for i in range(300))
    assert "4.0E7" in out._jdf.queryExecution().optimizedPlan().toString()
