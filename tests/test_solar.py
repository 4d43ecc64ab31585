import datetime as dt

from pyspark.sql import functions as F

from uas_spark.functions import solar


def _run(spark, rows):
    df = spark.createDataFrame(rows, "date string, lat double, lon double").withColumn("date", F.to_date("date"))
    return solar.sun_times(df).collect()


def test_documented_seattle_example_within_two_seconds(spark):
    r = _run(spark, [("2026-07-30", 47.6062, -122.3321)])[0]
    expect = {"dawn": "2026-07-30T12:08:12.821", "sunrise": "2026-07-30T12:44:35.217",
              "sunset": "2026-07-31T03:46:11.609", "dusk": "2026-07-31T04:22:23.394"}
    for k, v in expect.items():
        got = r[k].replace(tzinfo=None) if r[k].tzinfo else r[k]
        assert abs((got - dt.datetime.fromisoformat(v)).total_seconds()) <= 2.0, (k, got)
    assert r["dawn"] < r["sunrise"] < r["sunset"] < r["dusk"]


def test_polar_day_and_night_are_null(spark):
    for r in _run(spark, [("2026-06-21", 78.2232, 15.6267), ("2026-12-21", 78.2232, 15.6267)]):
        assert r["dawn"] is None and r["sunrise"] is None and r["sunset"] is None and r["dusk"] is None


def test_published_sunrise_and_sunset_times(spark):
    """Times of day (UTC) from published almanac tables, to the minute."""
    rows = [("2024-06-20", 51.5074, -0.1278, "03:43", "20:21"),   # London, midsummer
            ("2024-12-21", 40.7128, -74.0060, "12:17", "21:32"),  # New York, midwinter
            ("2024-03-20", 35.6762, 139.6503, "20:45", "08:53"),  # Tokyo, equinox
            ("2024-12-21", -33.8688, 151.2093, "18:41", "09:05")]  # Sydney, midsummer
    got = _run(spark, [r[:3] for r in rows])
    by = {(str(g["date"]), g["lat"]): g for g in got}
    for day, lat, _, rise, down in rows:
        g = by[day, lat]
        for have, want in ((g["sunrise"], rise), (g["sunset"], down)):
            minutes = int(want[:2]) * 60 + int(want[3:])
            off = (have.hour * 60 + have.minute + have.second / 60 - minutes + 720) % 1440 - 720
            assert abs(off) <= 2.5, (day, lat, have, want)
