from pyspark.sql import functions as F

from uas_spark.operators import validate as v
from uas_spark.sources import json_sources as js


def test_spatial_probe_validity(spark):
    rows = [(47.62, -122.41, None, None, None, None), (47.62, -122.41, 47.6, -122.4, 47.7, -122.3),
            (None, None, None, None, None, None), (47.62, None, None, None, None, None),
            (None, None, 47.6, -122.4, 47.6, -122.3), (None, None, 47.6, -122.4, 47.7, -122.4)]
    df = spark.createDataFrame(rows, "lat double, lon double, lat1 double, lon1 double, lat2 double, lon2 double")
    out = df.select(F.size(v.spatial_probe_issues("lat", "lon", "lat1", "lon1", "lat2", "lon2")).alias("n")).collect()
    assert [r.n for r in out] == [0, 1, 1, 1, 1, 1]


def test_coordinates_and_bad_vertex(spark):
    df = spark.createDataFrame([(90.0, 0.0), (89.9, 180.0), (0.0, 180.1)], "lat double, lon double")
    assert [r.ok for r in df.select(v.coordinates_ok(F.col("lat"), F.col("lon")).alias("ok")).collect()] == [
        False, True, False]
    txt = '{"type":"Polygon","coordinates":[[[-122.42,47.61],[-122.40,47.61],[200,47.61],[-122.42,47.61]]]}'
    d = spark.createDataFrame([(txt,)], "t string").select(js.geojson_decode(F.col("t")).alias("r"))
    r = d.select(v.vertices_ok(F.col("r")).alias("a"), v.polygon_ok(F.col("r")).alias("b")).first()
    assert r.a is False and r.b is True


def test_iso_text_rules(spark):
    df = spark.createDataFrame([("2026-07-25T14:03:11.000Z",), ("2026-07-25T14:03:11+02:00",), ("2026-07-25",)],
                               "t string")
    out = df.select(v.iso_instant_ok(F.col("t")).alias("i"), v.iso_date_ok(F.col("t")).alias("d")).collect()
    assert [(r.i, r.d) for r in out] == [(True, False), (False, False), (False, True)]


def test_instants_with_short_and_long_texts(spark):
    texts = ["2024-01-01T00:00Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00.1Z", "2024-01-01T02:00:00+02:00",
             "2024-01-01T24:00Z", "2024-02-30T00:00Z", "2024-01-01T00Z", "2024-01-01", "2024-01-01T00:00:00.Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(v.iso_instant_ok(F.col("t")).alias("ok"), F.unix_micros(js.to_instant(F.col("t"))).alias("us")).collect()
    t0 = 1_704_067_200_000_000
    assert [r.us for r in out] == [t0, t0 + 123456, t0 + 100000, t0, None, None, None, None, None, None]
    assert [r.ok for r in out] == [True, True, True] + [False] * 7


def test_positions_are_two_numbers(spark):
    def ring(first):
        return f'{{"type":"Polygon","coordinates":[[{first},[3.0,0.0],[3.0,3.0],[0.0,0.0]]]}}'
    texts = [ring("[0.0,0.0]"), ring("[0.0]"), ring("[0.0,0.0,5.0]"), ring("[]"), ring("[0.0,null]"), ring('"x"'),
             '{"type":"Polygon","coordinates":[[[1.0],[3.0],[3.0],[1.0]]]}', '{"type":"Polygon","coordinates":[]}',
             '{"type":"Polygon","coordinates":[[]]}', '{"type":"Point","coordinates":[1.0,2.0]}', "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(js.geojson_decode(F.col("t")).alias("r"))
    assert [r.ok for r in df.select(v.polygon_ok(F.col("r")).alias("ok")).collect()] == [True] + [False] * 11


def test_validate_report_joins_issues(spark):
    df = spark.createDataFrame([("hazy", 10.0), ("foggy", 5.0), ("clear", None)], "state string, ceiling double")
    rules = [v.Rule("state", "Invalid enum value", v.enum_ok(F.col("state"), "visibility_state")),
             v.Rule("ceilingFt", "required iff foggy", v.iff_present(F.col("state") == "foggy", F.col("ceiling")))]
    ok, bad = v.validate(df, rules)
    assert ok.count() == 2
    assert bad.first().reason == "state: Invalid enum value; ceilingFt: required iff foggy"


def test_one_or_many_bodies(spark):
    df = spark.createDataFrame([('{"reportId":"a"}',), ('[{"reportId":"b"},{"reportId":"c"}]',)], "body string")
    assert [r.reportId for r in js.parse_bodies(df, "body", js.POSITION_BODY).collect()] == ["a", "b", "c"]


def test_profile_must_be_object(spark):
    df = spark.createDataFrame([('{"pollIntervalMs":{"min":2000,"max":5000}}',), ("[1]",)], "t string")
    out = df.select(js.profile_is_object(js.profile_variant(F.col("t"))).alias("o"),
                    js.profile_extract(js.profile_variant(F.col("t")), "$.pollIntervalMs.min").alias("m")).collect()
    assert [(r.o, r.m) for r in out] == [(True, 2000), (False, None)]


def test_record_json_optional_fields(spark):
    import json

    from uas_spark.functions.timefn import api_projection, record_json
    df = spark.createDataFrame([("o1", "individual", None, None, "x"), ("o2", "organization", "Acme", None, None)],
                               "owner_id string, owner_type string, company_name string, address_line2 string, "
                               "email string")
    rec = api_projection(df)
    out = [json.loads(r[0]) for r in rec.select(record_json(rec)).collect()]
    assert out[0] == {"ownerId": "o1", "ownerType": "individual", "email": "x"}
    assert out[1] == {"ownerId": "o2", "ownerType": "organization", "email": None, "companyName": "Acme"}


def test_coordinate_text_coercion(spark):
    df = spark.createDataFrame([('{"lat": 47.6}',), ('{"lat": "47.6"}',), ('{"lat": "north"}',), ('{}',)], "raw string")
    out = df.select(js.number_field(F.col("raw"), "$.lat", True).alias("w"),
                    js.number_field(F.col("raw"), "$.lat", False).alias("log")).collect()
    assert [(r.w, r.log) for r in out] == [(47.6, 47.6), (47.6, None), (None, None), (None, None)]
