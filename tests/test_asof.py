import random

from pyspark.sql import functions as F

from uas_spark.functions import geo
from uas_spark.operators import asof, listings

STAMP = "2026-08-01 12:00:00"
SCHEMA = "report_id string, zone_id string, recorded_at timestamp, state string, ingested_at timestamp"


def _at(minutes):
    import datetime as dt
    return dt.datetime(2026, 8, 1, 12, 0) + dt.timedelta(minutes=minutes)


def _zones(spark, rows):
    return spark.createDataFrame([(r, z, _at(m), s, _at(i)) for r, z, m, s, i in rows], SCHEMA)


def test_fresh_and_stale(spark):
    obs = _zones(spark, [("a1", "A", -5, "clear", -5), ("b1", "B", -90, "foggy", -90)])
    fresh = asof.zone_latest_fresh(obs, STAMP, 30).collect()
    assert [r.zone_id for r in fresh] == ["A"]
    past = asof.zone_asof(obs, "2026-08-01 11:00:00").collect()
    assert [r.zone_id for r in past] == ["B"]


def test_nearest_forecast_is_not_at_or_before(spark):
    fc = _zones(spark, [("f1", "A", 240, "clear", 0), ("f2", "A", 360, "rainy", 0)])
    r = asof.zone_forecast_nearest(fc, "2026-08-01 16:05:00").collect()
    assert [x.report_id for x in r] == ["f1"]
    # a forecast after the instant can be nearest
    r = asof.zone_forecast_nearest(fc, "2026-08-01 17:59:00").collect()
    assert [x.report_id for x in r] == ["f2"]


def test_forecast_tie_goes_to_newest_ingested(spark):
    fc = _zones(spark, [("f1", "A", 0, "clear", -60), ("f2", "A", 0, "rainy", -30)])
    assert asof.zone_forecast_nearest(fc, STAMP).first().report_id == "f2"


def test_history_range_limit(spark):
    obs = _zones(spark, [("h1", "A", -30, "clear", -30), ("h2", "A", -20, "clear", -20),
                         ("h3", "A", -10, "clear", -10)])
    ids = lambda df: [r.report_id for r in df.collect()]
    assert ids(listings.history(obs, "zone_id", key="A", from_ts="2026-08-01 11:35:00")) == ["h2", "h3"]
    assert ids(listings.history(obs, "zone_id", key="A", to_ts="2026-08-01 11:45:00")) == ["h1", "h2"]
    assert ids(listings.history(obs, "zone_id", key="A", from_ts="2026-08-01 11:35:00",
                                to_ts="2026-08-01 11:45:00")) == ["h2"]
    assert ids(listings.history(obs, "zone_id", key="A", limit=1)) == ["h1"]
    assert asof.zone_asof(obs, "2026-08-01 11:45:00").first().report_id == "h2"


def _brute_asof(probes, reports):
    out = {}
    for pid, z, t in probes:
        best = None
        for rid, rz, rt in reports:
            if rz == z and rt <= t and (best is None or rt > best[1] or (rt == best[1] and rid < best[0])):
                best = (rid, rt)
        out[pid] = best[0] if best else None
    return out


def test_bucketed_asof_join_matches_brute_force(spark):
    rnd = random.Random(3)
    reports = [(f"r{i:03d}", f"Z{rnd.randint(0, 3)}", _at(rnd.randint(-3000, 3000))) for i in range(200)]
    reports += [("r999", reports[0][1], reports[0][2])]  # same-instant tie
    probes = [(f"p{i}", f"Z{rnd.randint(0, 4)}", _at(rnd.randint(-4000, 4000))) for i in range(300)]
    rdf = spark.createDataFrame([(a, b, c, "s", c) for a, b, c in reports], SCHEMA)
    pdf = spark.createDataFrame(probes, "probe_id string, zone_id string, at timestamp")
    got = {r.probe_id: (r.rep.report_id if r.rep else None)
           for r in asof.join_zone_asof(pdf, rdf, bucket_us=asof.HOUR_US).collect()}
    assert got == _brute_asof(probes, reports)


def test_nearest_join_matches_single_probe_rule(spark):
    rnd = random.Random(5)
    rows = [(f"f{i:03d}", f"Z{rnd.randint(0, 2)}", rnd.randint(-40, 40) * 30, "s", rnd.randint(-300, 0))
            for i in range(120)]
    fc = _zones(spark, rows)
    probes = [(f"p{i}", f"Z{rnd.randint(0, 2)}", _at(rnd.randint(-1300, 1300))) for i in range(150)]
    pdf = spark.createDataFrame(probes, "probe_id string, zone_id string, at timestamp")
    got = {r.probe_id: r.rep.report_id for r in asof.join_zone_forecast_nearest(pdf, fc, bucket_us=asof.HOUR_US)
           .collect() if r.rep is not None}
    for pid, z, t in probes:
        one = asof.zone_forecast_nearest(fc.filter(F.col("zone_id") == z), t.strftime("%Y-%m-%d %H:%M:%S")).collect()
        if one:
            assert got[pid] == one[0].report_id, pid


def test_latest_position_ties_by_report_id(spark):
    df = spark.createDataFrame([("b", "SN", _at(0)), ("a", "SN", _at(0)), ("c", "SN", _at(-1))],
                               "report_id string, drone_serial_number string, recorded_at timestamp")
    assert asof.latest_position(df).first().report_id == "a"


def test_positions_zone_current_matches_asof_then_polygon(spark):
    from uas_spark.operators import spatial
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        x0, y0 = rnd.randint(0, 20) / 16, rnd.randint(0, 20) / 16
        rows.append((f"z{i:02d}", f"Z{i % 3}", _at(rnd.randint(-600, 600)), "s", _at(0), x0, y0))
    zdf = spark.createDataFrame(rows, SCHEMA + ", x0 double, y0 double").withColumn(
        "rings", geo.box_rings(F.col("x0"), F.col("y0"), F.col("x0") + 0.5, F.col("y0") + 0.5)).drop("x0", "y0")
    pos = [(f"p{i}", _at(rnd.randint(-700, 700)), rnd.randint(1, 100) / 64 + 1 / 256, rnd.randint(1, 100) / 64 + 1 / 256)
           for i in range(200)]
    pdf = spark.createDataFrame(pos, "report_id string, recorded_at timestamp, longitude double, latitude double")
    got = {(r.report_id, r.z_report_id) for r in spatial.join_positions_zone_current(pdf, zdf).collect()}
    expect = set()
    for pid, t, x, y in pos:
        for z in ("Z0", "Z1", "Z2"):
            cands = [r for r in rows if r[1] == z and r[2] <= t]
            if cands:
                best = max(cands, key=lambda r: (r[2], [-ord(c) for c in r[0]]))
                if best[5] < x < best[5] + 0.5 and best[6] < y < best[6] + 0.5:
                    expect.add((pid, best[0]))
    assert got == expect


def test_positions_forecast_zone_matches_nearest_then_polygon(spark):
    from uas_spark.operators import spatial
    rnd = random.Random(17)
    rows = []
    for i in range(80):
        x0, y0 = rnd.randint(0, 20) / 16, rnd.randint(0, 20) / 16
        # several forecasts share target instants (multiples of 60 min), issued at different times
        rows.append((f"f{i:02d}", f"Z{i % 3}", _at(rnd.randint(-10, 10) * 60), "s", _at(rnd.randint(-900, -1)), x0, y0))
    zdf = spark.createDataFrame(rows, SCHEMA + ", x0 double, y0 double").withColumn(
        "rings", geo.box_rings(F.col("x0"), F.col("y0"), F.col("x0") + 0.5, F.col("y0") + 0.5)).drop("x0", "y0")
    pos = [(f"p{i}", _at(rnd.randint(-20, 20) * 30), rnd.randint(1, 100) / 64 + 1 / 256,
            rnd.randint(1, 100) / 64 + 1 / 256) for i in range(200)]
    pdf = spark.createDataFrame(pos, "report_id string, recorded_at timestamp, longitude double, latitude double")
    got = {(r.report_id, r.z_report_id) for r in spatial.join_positions_forecast_zone(pdf, zdf).collect()}
    expect = set()
    for pid, t, x, y in pos:
        for z in ("Z0", "Z1", "Z2"):
            cands = [r for r in rows if r[1] == z]
            best = min(cands, key=lambda r: (abs((r[2] - t).total_seconds()), -r[4].timestamp(), r[0]))
            if best[5] < x < best[5] + 0.5 and best[6] < y < best[6] + 0.5:
                expect.add((pid, best[0]))
    assert got == expect
