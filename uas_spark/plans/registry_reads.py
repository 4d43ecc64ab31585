"""Registered queries: validation (V1-V12), sources and projection (S1-S9, S12, C5),
single-probe spatial search (X2-X8, X11) and sensor operators (N1-N3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timefn import api_projection, iso_text, record_json
from ..operators import covering
from ..operators import sensors as sn
from ..operators import spatial
from ..operators import validate as v
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import json_sources as js
from . import oracle_fixtures as of
from .oracle_fixtures import contains_sql, iso, with_fixtures
from .registry import _BOXES_SQL as _BOX_SQL
from .registry import FORECAST_AT, query

# ============================================================ V1-V12


def _events(spark, sf_dir):
    return fx.load(spark, sf_dir, "events")


@query("val_coordinates", """
SELECT event_id, (47.0 + value / 4 > -90 AND 47.0 + value / 4 < 90 AND value - 300 >= -180 AND value - 300 <= 180)
       AS ok FROM events""")
def q_val_coordinates(spark, sf_dir):
    """V1 on points built from events: lat = 47 + value/4, lon = value - 300 (some out of range)."""
    e = _events(spark, sf_dir)
    return e.select("event_id", v.coordinates_ok(F.lit(47.0) + F.col("value") / 4, F.col("value") - 300).alias("ok"))


def _raw_rings(e):
    """Zone polygons with some broken: every 9th ring left open, every 11th cut to 3 positions."""
    eid = F.col("event_id")
    cx = F.lit(-123.0) + (eid * 13 % 1024).cast("double") / 1024.0
    cy = F.lit(47.0) + (eid * 5 % 512).cast("double") / 1024.0
    h = (F.lit(8) + eid % 25).cast("double") / 256.0
    pts = [geo.vertex(cx - h, cy - h), geo.vertex(cx + h, cy - h), geo.vertex(cx + h, cy + h),
           geo.vertex(cx - h, cy + h)]
    closed = F.array(*pts, pts[0])
    ring = (F.when(eid % 9 == 0, F.array(*pts)).when(eid % 11 == 0, F.array(pts[0], pts[1], pts[0]))
             .otherwise(closed))
    return F.array(ring)


@query("val_polygon", """
SELECT event_id, NOT (event_id % 9 = 0 OR event_id % 11 = 0 OR event_id % 7 IN (2, 4)) AS ok FROM events""")
def q_val_polygon(spark, sf_dir):
    """V2 on GeoJSON texts: closed rings of at least 4 positions of two numbers each; some texts give
    the first positions one or three numbers."""
    e = _events(spark, sf_dir)
    text = js.geojson_encode(_raw_rings(e))
    m = F.col("event_id") % 7
    text = (F.when(m == 2, F.regexp_replace(text, r"\[(-?[0-9.]+),[-0-9.]+\],", "[$1],"))
             .when(m == 4, F.regexp_replace(text, r"\],\[", ",5.0],[")).otherwise(text))
    return e.select("event_id", v.polygon_ok(js.geojson_decode(text)).alias("ok"))


def _probe_fields(e):
    """Spatial probes with fields dropped by event id pattern."""
    eid = F.col("event_id")
    lat = F.lit(47.0) + (eid % 512).cast("double") / 1024.0
    lon = F.lit(-123.0) + (eid % 1024).cast("double") / 1024.0
    m = eid % 8
    return e.select(
        "event_id",
        F.when(m.isin(0, 2, 3), lat).alias("lat"), F.when(m.isin(0, 3), lon).alias("lon"),
        F.when(m.isin(1, 2, 4, 5, 6), lat).alias("lat1"), F.when(m.isin(1, 2, 5, 6), lon).alias("lon1"),
        F.when(m.isin(1, 2, 5, 6), F.when(m == 5, lat).otherwise(lat + 0.01)).alias("lat2"),
        F.when(m.isin(1, 2, 5, 6), F.when(m.isin(5, 6), lon).otherwise(lon + 0.01)).alias("lon2"))


@query("val_spatial_probe", """
SELECT event_id,
  CASE event_id % 8 WHEN 0 THEN 'point' WHEN 3 THEN 'point' WHEN 1 THEN 'extent' END AS kind,
  CASE event_id % 8
    WHEN 2 THEN ': Provide either lat/lon or lat1/lon1/lat2/lon2, not both'
    WHEN 4 THEN 'lat1: lat1, lon1, lat2, and lon2 must all be provided'
    WHEN 7 THEN ': Provide either a point (lat/lon) or an extent (lat1/lon1/lat2/lon2)'
    WHEN 5 THEN 'lat2: The extent must have nonzero height (lat1 and lat2 must differ); lon2: The extent must have nonzero width (lon1 and lon2 must differ)'
    WHEN 6 THEN 'lon2: The extent must have nonzero width (lon1 and lon2 must differ)'
    ELSE '' END AS report
FROM events""")
def q_val_spatial_probe(spark, sf_dir):
    """V3 + X10 + V12: probe validity report and the resolved kind."""
    p = _probe_fields(_events(spark, sf_dir))
    iss = v.spatial_probe_issues("lat", "lon", "lat1", "lon1", "lat2", "lon2")
    kind = v.spatial_filter_kind("lat", "lon", "lat1", "lon1", "lat2", "lon2")
    return p.select("event_id", F.when(F.size(iss) == 0, kind).alias("kind"), v.reject_report(iss).alias("report"))


@query("val_state_enum", """
SELECT event_id, event_id % 6 <> 5 AS ok FROM events""")
def q_val_state_enum(spark, sf_dir):
    """V4: visibility states with an unknown sixth value."""
    e = _events(spark, sf_dir)
    states = F.array(*[F.lit(s) for s in fx.VISIBILITY_STATES + ["hazy"]])
    st = F.element_at(states, (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", v.enum_ok(st, "visibility_state").alias("ok"))


@query("val_conditional_presence", """
SELECT c_custkey, (c_mktsegment = 'BUILDING') = (c_mktsegment = 'BUILDING' OR c_custkey % 7 = 0) AS ok
FROM customer""")
def q_val_conditional_presence(spark, sf_dir):
    """V5: company name iff organization; every 7th body names a company regardless."""
    c = fx.load(spark, sf_dir, "customer")
    org = F.col("c_mktsegment") == "BUILDING"
    company = F.when(org | (F.col("c_custkey") % 7 == 0), F.col("c_name"))
    return c.select("c_custkey", v.iff_present(org, company).alias("ok"))


@query("val_interval_order", """
SELECT o_orderkey, o_orderkey % 60 - 5 >= 0 AS reg_ok, o_orderkey % 12 - 2 > 0 AS window_ok FROM orders""")
def q_val_interval_order(spark, sf_dir):
    """V6: registration end >= start (closed); authorization end > start (strict)."""
    o = fx.load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d0 = F.to_date(F.lit("2024-01-01"))
    t0 = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return o.select("o_orderkey",
                    v.interval_ok(d0, F.date_add(d0, (k % 60 - 5).cast("int")), True).alias("reg_ok"),
                    v.interval_ok(t0, t0 + F.make_dt_interval(F.lit(0), (k % 12 - 2).cast("int")), False)
                     .alias("window_ok"))


@query("val_altitude", with_fixtures("lineitem_pairs") + """
SELECT l_orderkey, l_linenumber, l_quantity * 45 <= 2000 AS ceiling_ok,
       (l_partkey % 300) * 5 > l_quantity * 4 AND (l_partkey % 300) * 5 <= 2000 AS band_ok
FROM lineitem_pairs""")
def q_val_altitude(spark, sf_dir):
    """V7: ceilings 0..2000 inclusive; waypoint bands with max > min."""
    p = fx.lineitem_pairs(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", v.altitude_ok(F.col("l_quantity") * 45).alias("ceiling_ok"),
                    v.band_ok(F.col("l_quantity") * 4, (F.col("l_partkey") % 300) * 5).alias("band_ok"))


def _plan_bodies(spark, sf_dir):
    o = fx.load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    wp = F.lit('"planType":"waypoints","waypoints":[{"latitude":47.6,"longitude":-122.4,"altitudeMinFt":100,'
               '"altitudeMaxFt":200,"radiusMeters":50}]')
    poly = F.lit('"planType":"polygon","polygonArea":{"type":"Polygon","coordinates":[]},"polygonMaxAltitudeFt":300')
    body = (F.when(k % 2 == 0, wp).otherwise(poly))
    body = F.when(k % 10 == 4, F.concat(body, F.lit(',"polygonMaxAltitudeFt":1'))).otherwise(body)
    body = F.when(k % 11 == 0, F.concat(body, F.lit(',"color":"red"'))).otherwise(body)
    body = F.when(k % 13 == 0, F.lit('"planType":"waypoints","waypoints":[]')).otherwise(body)
    return o.select("o_orderkey", F.concat(F.lit('{"flightPlanId":"FP-'), k.cast("string"), F.lit('",'), body,
                                           F.lit("}")).alias("raw"))


@query("val_plan_shape", """
SELECT o_orderkey, NOT (o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 10 = 4) AS ok FROM orders""")
def q_val_plan_shape(spark, sf_dir):
    """V8: plan body shape from the raw JSON (unknown keys rejected)."""
    b = _plan_bodies(spark, sf_dir)
    return b.select("o_orderkey", v.plan_shape_ok(F.col("raw")).alias("ok"))


@query("val_required_text", """
SELECT c_custkey, c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AS ok FROM customer""")
def q_val_required_text(spark, sf_dir):
    """V9: first name and owner id nonempty (every 13th first name empty, every 17th id empty)."""
    c = fx.load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first = F.when(k % 13 == 0, F.lit("")).otherwise(F.col("c_name"))
    oid = F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("O-"), k.cast("string")))
    return c.select("c_custkey", (v.text_ok(first) & v.text_ok(oid)).alias("ok"))


@query("val_positive_radius", """
SELECT s_suppkey, s_suppkey % 7 > 2 AS ok FROM supplier""")
def q_val_positive_radius(spark, sf_dir):
    """V9: sensing radii must be positive; some are negative, zero or missing."""
    s = fx.load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 7
    return s.select("s_suppkey", v.positive_ok(F.when(k != 1, (k - 2) * 500.0)).alias("ok"))


@query("val_iso_time", f"""
SELECT event_id, event_id % 8 IN (0, 1, 4, 5) AS instant_ok, event_id % 3 = 0 AS date_ok,
       CASE event_id % 8 WHEN 0 THEN {iso("date_trunc('millisecond', ts)")} WHEN 1 THEN {iso("date_trunc('second', ts)")}
            WHEN 2 THEN {iso("date_trunc('second', ts) - INTERVAL 2 HOUR")} WHEN 4 THEN {iso("date_trunc('minute', ts)")}
            WHEN 5 THEN {iso("date_trunc('second', ts) + INTERVAL 123456 MICROSECOND")} END AS instant
FROM events""")
def q_val_iso_time(spark, sf_dir):
    """Instants must be ISO UTC with Z (offsets and bare dates refused), seconds optional and any
    number of fraction digits; dates YYYY-MM-DD only. ``instant`` is what the text is read as."""
    e = _events(spark, sf_dir)
    m = F.col("event_id") % 8
    t = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
          .when(m == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
          .when(m == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
          .when(m == 3, F.date_format("ts", "yyyy-MM-dd"))
          .when(m == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
          .when(m == 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.123456789Z'"))
          .when(m == 6, F.date_format("ts", "yyyy-MM-dd'T25:'mm:ss'Z'"))
          .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH'Z'")))
    d = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
          .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
          .otherwise(F.lit("2024-02-30")))
    return e.select("event_id", v.iso_instant_ok(t).alias("instant_ok"), v.iso_date_ok(d).alias("date_ok"),
                    iso_text(js.to_instant(t)).alias("instant"))


@query("val_history_query", """
SELECT event_id, CAST(floor(value) AS BIGINT) > 0 AND event_id % 5 <> 0 AS limit_ok,
       event_id % 3 <> 0 OR event_id % 2 = 0 AS at_ok FROM events""")
def q_val_history_query(spark, sf_dir):
    """``limit`` text must be a positive integer; forecast history requires ``at``."""
    e = _events(spark, sf_dir)
    lim = F.when(F.col("event_id") % 5 == 0, F.lit("ten")).otherwise(F.floor("value").cast("long").cast("string"))
    is_forecast = F.col("event_id") % 3 == 0
    at = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", v.positive_int_text(lim).alias("limit_ok"),
                    (~is_forecast | (at.isNotNull() & v.iso_instant_ok(at))).alias("at_ok"))


@query("reject_report", with_fixtures("zone_reports") + """
SELECT report_id,
  concat_ws('; ',
    CASE WHEN event_id % 6 = 5 THEN 'state: Invalid enum value' END,
    CASE WHEN (event_id % 6 = 2) <> (event_id % 4 = 1 OR event_id % 6 = 2) THEN 'ceilingFt: ceilingFt is required when state is ''foggy'', and not allowed otherwise' END,
    CASE WHEN NOT (47.0 + value / 4 > -90 AND 47.0 + value / 4 < 90) THEN 'polygon: latitude out of range' END) AS reason
FROM zone_reports WHERE event_id % 6 = 5 OR (event_id % 6 = 2) <> (event_id % 4 = 1 OR event_id % 6 = 2)
   OR NOT (47.0 + value / 4 > -90 AND 47.0 + value / 4 < 90)""".replace("FROM zone_reports", "FROM (SELECT z.*, e.value FROM zone_reports z JOIN events e USING (event_id))"))
def q_reject_report(spark, sf_dir):
    """V4 + V5 + V1 + V12 on zone report bodies: every failing rule, joined."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    states = F.array(*[F.lit(s) for s in fx.VISIBILITY_STATES + ["hazy"]])
    st = F.element_at(states, (eid % 6 + 1).cast("int"))
    ceiling = F.when((eid % 6 == 2) | (eid % 4 == 1), F.col("value") * 10)
    body = e.select(F.concat(F.lit("z-"), eid.cast("string")).alias("report_id"), st.alias("state"),
                    ceiling.alias("ceiling_ft"), (F.lit(47.0) + F.col("value") / 4).alias("vlat"))
    rules = [v.Rule("state", "Invalid enum value", v.enum_ok(F.col("state"), "visibility_state")),
             v.Rule("ceilingFt", v.CEILING_MESSAGE,
                    v.iff_present(F.col("state") == "foggy", F.col("ceiling_ft"))),
             v.Rule("polygon", "latitude out of range", v.coordinates_ok(F.col("vlat"), F.lit(0.0)))]
    _, bad = v.validate(body, rules)
    return bad.select("report_id", "reason")


# ============================================================ S1-S9, S12, C5

def _position_bodies(spark, sf_dir, with_sensor=False):
    """One body per event: odd events send a one-element array, even ones a bare object."""
    e = _events(spark, sf_dir)
    item = F.struct(F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("reportId"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("recordedAt"),
                    (F.lit(47.0) + (F.col("event_id") % 512).cast("double") / 1024.0).alias("latitude"),
                    (F.lit(-123.0) + (F.col("event_id") * 7 % 1024).cast("double") / 1024.0).alias("longitude"),
                    F.col("value").alias("altitudeFt"),
                    *([F.concat(F.lit("S-"), (F.col("event_id") % 13).cast("string")).alias("sensorId")]
                      if with_sensor else []))
    body = F.when(F.col("event_id") % 2 == 1, F.to_json(F.array(item))).otherwise(F.to_json(item))
    return e.select(F.concat(F.lit("SN-"), F.col("user_id").cast("string")).alias("serial"), body.alias("body"))


@query("src_live_positions", with_fixtures("live_positions") + f"""
SELECT report_id, drone_serial_number, {iso('recorded_at')} AS recorded_at, latitude, altitude_ft
FROM live_positions""")
def q_src_live_positions(spark, sf_dir):
    b = _position_bodies(spark, sf_dir)
    r = js.parse_bodies(b, "body", js.POSITION_BODY, keep=["serial"])
    return r.select(F.col("reportId").alias("report_id"), F.col("serial").alias("drone_serial_number"),
                    js.to_instant(F.col("recordedAt")).alias("recorded_at"), "latitude",
                    F.col("altitudeFt").alias("altitude_ft"))


@query("src_sensor_positions", with_fixtures("live_positions") + """
SELECT report_id, 'S-' || CAST(event_id % 13 AS VARCHAR) AS sensor_id, longitude FROM live_positions""")
def q_src_sensor_positions(spark, sf_dir):
    b = _position_bodies(spark, sf_dir, with_sensor=True)
    r = js.parse_bodies(b, "body", js.POSITION_BODY, keep=["serial"])
    return r.select(F.col("reportId").alias("report_id"), F.col("sensorId").alias("sensor_id"), "longitude")


def _zone_bodies(spark, sf_dir, layer):
    z = fx.zone_reports(spark, sf_dir, layer)
    extra = [F.col("ceiling_ft").alias("ceilingFt")] if layer == "visibility" else []
    return z.select("kind", F.to_json(F.struct(F.col("report_id").alias("reportId"), F.col("zone_id").alias("zoneId"),
                                               F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
                                               .alias("recordedAt"), "state", *extra,
                                               js.geojson_encode(F.col("rings")).alias("polygon"))).alias("body"))


def _zone_src(spark, sf_dir, layer):
    b = _zone_bodies(spark, sf_dir, layer)
    r = js.parse_bodies(b, "body", js.ZONE_BODY, keep=["kind"])
    rings = js.geojson_decode(F.col("polygon"))
    return r.select(F.col("reportId").alias("report_id"), "kind", "state",
                    F.size(F.flatten(rings)).cast("long").alias("n_vertices"),
                    F.size(rings).cast("long").alias("n_rings"), rings[0][0]["lon"].alias("lon0"))


_ZONE_SRC_SQL = """
SELECT report_id, kind, state,
       CAST(CASE shape WHEN 'tri' THEN 4 WHEN 'holed' THEN 10 ELSE 5 END AS BIGINT) AS n_vertices,
       CAST(CASE shape WHEN 'holed' THEN 2 ELSE 1 END AS BIGINT) AS n_rings, cx - h AS lon0 FROM {t}"""


@query("src_visibility_reports", with_fixtures("zone_reports") + _ZONE_SRC_SQL.format(t="zone_reports"))
def q_src_visibility_reports(spark, sf_dir):
    """S3 (+S8 round trip): visibility bodies with GeoJSON polygons; kind selects the table."""
    return _zone_src(spark, sf_dir, "visibility")


@query("src_wind_reports", with_fixtures("wind_reports") + _ZONE_SRC_SQL.format(t="wind_reports"))
def q_src_wind_reports(spark, sf_dir):
    """S4."""
    return _zone_src(spark, sf_dir, "wind")


@query("src_authorizations", """
SELECT 'FP-' || CAST(o_orderkey AS VARCHAR) AS flight_plan_id,
       CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 2 = 0 THEN 'waypoints' ELSE 'polygon' END AS plan_type,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_waypoints,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 300.0::DOUBLE
            WHEN o_orderkey % 10 = 4 THEN 1.0::DOUBLE END AS ceiling
FROM orders""")
def q_src_authorizations(spark, sf_dir):
    """Flight plan bodies of both shapes parsed into one schema with nullable branches."""
    b = _plan_bodies(spark, sf_dir)
    r = b.select(F.from_json("raw", f"struct<{js.PLAN_BODY}>").alias("p")).select("p.*")
    return r.select(F.col("flightPlanId").alias("flight_plan_id"), F.col("planType").alias("plan_type"),
                    F.size("waypoints").cast("long").alias("n_waypoints"),
                    F.col("polygonMaxAltitudeFt").alias("ceiling")).withColumn(
        "n_waypoints", F.coalesce(F.col("n_waypoints"), F.lit(0).cast("long")))


@query("src_sensors_profiles", with_fixtures("sensors") + """
SELECT sensor_id, CASE WHEN CAST(substr(sensor_id, 3) AS BIGINT) % 4 = 0 THEN 'offline' ELSE status END AS status,
       CAST(substr(sensor_id, 3) AS BIGINT) % 3 = 0 AS profile_is_object FROM sensors""")
def q_src_sensors_profiles(spark, sf_dir):
    """Sensor bodies (status omitted on every 4th, defaulting to offline) and profile
    documents (every 3rd an object, others a JSON array, which is refused)."""
    s = fx.sensors(spark, sf_dir)
    k = F.expr("cast(substring(sensor_id, 3) as bigint)")
    body = F.to_json(F.struct(F.col("sensor_id").alias("sensorId"), "name",
                              F.when(k % 4 != 0, F.col("status")).alias("status")))
    prof = F.when(k % 3 == 0, F.lit('{"pollIntervalMs":{"min":2000,"max":5000}}')).otherwise(F.lit("[1,2]"))
    parsed = js.sensors_from_bodies(s.select(body.alias("body"), prof.alias("prof"), k.alias("k")).withColumn(
        "body", F.col("body")), "body")
    ok = s.select("sensor_id", js.profile_is_object(js.profile_variant(prof)).alias("profile_is_object"))
    return parsed.select(F.col("sensorId").alias("sensor_id"), "status").join(ok, "sensor_id")


@query("geojson_decode", with_fixtures("authorizations") + """
SELECT authorization_id, CAST(CASE WHEN o_orderkey % 10 = 7 THEN 4 WHEN shape = 'tri' THEN 4 ELSE 5 END AS BIGINT) AS n_vertices,
       CAST(CASE WHEN o_orderkey % 10 = 7 THEN 4 WHEN o_orderkey % 10 = 8 THEN 1 ELSE 0 END AS BIGINT) AS n_refused,
       CASE WHEN o_orderkey % 10 NOT IN (7, 8) THEN cx - h END AS min_lon,
       CASE WHEN o_orderkey % 10 NOT IN (7, 8) THEN cy + h END AS max_lat FROM authorizations""")
def q_geojson_decode(spark, sf_dir):
    """Authorization areas encoded to GeoJSON text and decoded back. Some texts hold positions of
    one number, some a third number in the first position: such positions are decoded to null."""
    a = fx.authorizations(spark, sf_dir)
    m = F.expr("CAST(substring(authorization_id, 3) AS BIGINT) % 10")
    text = js.geojson_encode(F.col("area"))
    text = (F.when(m == 7, F.lit('{"type":"Polygon","coordinates":[[[1.0],[3.0],[3.0],[1.0]]]}'))
             .when(m == 8, F.regexp_replace(text, r"^([^\]]*)\]", "$1,5.0]")).otherwise(text))
    rings = js.geojson_decode(text)
    flat = F.flatten(rings)
    whole = F.forall(flat, lambda p: p.isNotNull())
    b = geo.bbox(rings)
    return a.select("authorization_id", F.size(flat).cast("long").alias("n_vertices"),
                    F.size(F.filter(flat, lambda p: p.isNull())).cast("long").alias("n_refused"),
                    F.when(whole, b["min_lon"]).alias("min_lon"), F.when(whole, b["max_lat"]).alias("max_lat"))


@query("api_projection", with_fixtures("owners") + """
SELECT owner_id AS "ownerId", owner_type AS "ownerType", company_name AS "companyName",
       strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS "createdAt" FROM owners""")
def q_api_projection(spark, sf_dir):
    """Stored owners to public records (camelCase, ISO instants with milliseconds)."""
    o = fx.owners(spark, sf_dir).select("owner_id", "owner_type", "company_name", "created_at")
    return api_projection(o)


@query("api_records", with_fixtures("owners", "sensors", "observed_reports", "pilots") + """
SELECT 'owner' AS kind, owner_id AS id, 'addressCity,' || CASE WHEN address_line2 IS NULL THEN 'addressLine1'
         ELSE 'addressLine1,addressLine2' END || CASE WHEN company_name IS NULL THEN '' ELSE ',companyName' END
         || ',createdAt,ownerId' AS keys, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM owners
UNION ALL
SELECT 'sensor', sensor_id, 'createdAt,notes,sensorId,status', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') FROM sensors
UNION ALL
SELECT 'zone', report_id, CASE WHEN ceiling_ft IS NULL THEN '' ELSE 'ceilingFt,' END || 'recordedAt,reportId,state',
       strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%gZ') FROM observed_reports
UNION ALL
SELECT 'pilot', pilot_id, 'createdAt,licenseNumber,pilotId', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') FROM pilots""")
def q_api_records(spark, sf_dir):
    """S12 as JSON records of four types: optional fields are left out when null (company name,
    second address line, ceiling), other nulls are written (a sensor's notes)."""
    tables = {"owner": (fx.owners(spark, sf_dir), ["owner_id", "company_name", "address_line1", "address_line2",
                                                   "address_city", "created_at"]),
              "sensor": (fx.sensors(spark, sf_dir), ["sensor_id", "notes", "status", "created_at"]),
              "zone": (fx.observed_reports(spark, sf_dir), ["report_id", "state", "ceiling_ft", "recorded_at"]),
              "pilot": (fx.pilots(spark, sf_dir), ["pilot_id", "license_number", "created_at"])}
    out = None
    for kind, (df, cols) in tables.items():
        rec = api_projection(df.select(*cols))
        one = rec.select(F.lit(kind).alias("kind"), record_json(rec).alias("j")).select(
            "kind", F.get_json_object("j", "$." + rec.columns[0]).alias("id"),
            F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"),
            F.get_json_object("j", "$." + rec.columns[-1]).alias("stamp"))
        out = one if out is None else out.unionByName(one)
    return out


@query("json_profile_extract", with_fixtures("sensor_profiles") + """
SELECT sensor_id, poll_min, latency_max, label FROM sensor_profiles""")
def q_json_profile_extract(spark, sf_dir):
    """Tuning values read from the opaque profile document, parsed once into a VARIANT column of
    a Parquet table (S7) and read from there by path."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
    js.store_profiles(fx.sensor_profiles_raw(spark, sf_dir), path)
    p, var = spark.read.parquet(path), F.col("profile")
    return p.select("sensor_id", js.profile_extract(var, "$.pollIntervalMs.min", "int").cast("long").alias("poll_min"),
                    js.profile_extract(var, "$.latencyMs.max", "int").cast("long").alias("latency_max"),
                    js.profile_extract(var, "$.label", "string").alias("label"))


# ============================================================ X2-X8, X11

def _points(spark, sf_dir):
    return fx.live_positions(spark, sf_dir).select(F.col("report_id").alias("probe_id"), F.col("latitude").alias("lat"),
                                                   F.col("longitude").alias("lon"), "recorded_at", "altitude_ft")


_POINTS_SQL = ("points AS (SELECT report_id AS probe_id, latitude AS lat, longitude AS lon, recorded_at, altitude_ft "
               "FROM live_positions)")


@query("zone_forecast_at_point", with_fixtures("live_positions", "forecast_reports") + f""",
{_POINTS_SQL},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY
          abs(epoch_us(recorded_at) - epoch_us(TIMESTAMP '{FORECAST_AT}')), ingested_at DESC, report_id) rn
          FROM forecast_reports) WHERE rn = 1)
SELECT p.probe_id, z.zone_id, z.report_id FROM points p JOIN pick z ON {contains_sql('p.lon', 'p.lat', 'z')}""")
def q_zone_forecast_at_point(spark, sf_dir):
    out = spatial.zone_forecast_at_point(fx.forecast_reports(spark, sf_dir),
                                         _points(spark, sf_dir).select("probe_id", "lat", "lon"), FORECAST_AT)
    return out.select("probe_id", F.col("z_zone_id").alias("zone_id"), F.col("z_report_id").alias("report_id"))


def _boxes(spark, sf_dir):
    from .registry import _event_boxes
    return _event_boxes(spark, sf_dir)


@query("zone_observed_in_extent", with_fixtures("observed_reports") + f""",
{_BOX_SQL},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
                        FROM observed_reports WHERE recorded_at <= TIMESTAMP '2024-01-20 12:00:00') WHERE rn = 1)
SELECT b.box_id, z.zone_id FROM boxes b JOIN pick z ON {of.box_meets_sql('z', 'b.bx0', 'b.by0', 'b.bx1', 'b.by1')}""")
def q_zone_observed_in_extent(spark, sf_dir):
    """X11 (observed, as of a time): zones meeting each box; corners given in either order."""
    out = spatial.zone_observed_in_extent(fx.observed_reports(spark, sf_dir),
                                          _boxes(spark, sf_dir).select("box_id", "box"), at="2024-01-20 12:00:00")
    return out.select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("zone_forecast_in_extent", with_fixtures("forecast_reports") + f""",
{_BOX_SQL},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY
          abs(epoch_us(recorded_at) - epoch_us(TIMESTAMP '{FORECAST_AT}')), ingested_at DESC, report_id) rn
          FROM forecast_reports) WHERE rn = 1)
SELECT b.box_id, z.zone_id FROM boxes b JOIN pick z ON {of.box_meets_sql('z', 'b.bx0', 'b.by0', 'b.bx1', 'b.by1')}""")
def q_zone_forecast_in_extent(spark, sf_dir):
    out = spatial.zone_forecast_in_extent(fx.forecast_reports(spark, sf_dir),
                                          _boxes(spark, sf_dir).select("box_id", "box"), FORECAST_AT)
    return out.select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("auth_covering", with_fixtures("live_positions", "authorizations") + f""",
{_POINTS_SQL}
SELECT p.probe_id, a.authorization_id FROM points p JOIN authorizations a
  ON a.status = 'approved' AND a.start_time <= TIMESTAMP '2024-01-20 12:00:00'
 AND a.end_time >= TIMESTAMP '2024-01-20 12:00:00' AND {contains_sql('p.lon', 'p.lat', 'a')}""")
def q_auth_covering(spark, sf_dir):
    """Approved authorizations covering each point at one instant, no altitude given."""
    pts = _points(spark, sf_dir).select("probe_id", "lat", "lon").withColumn(
        "at", F.to_timestamp(F.lit("2024-01-20 12:00:00")))
    out = spatial.covering_authorizations(fx.authorizations(spark, sf_dir), pts, "at", status="approved")
    return out.select("probe_id", F.col("a_authorization_id").alias("authorization_id"))


@query("auth_intersecting", with_fixtures("authorizations") + f""",
{_BOX_SQL}
SELECT b.box_id, a.authorization_id FROM boxes b JOIN authorizations a
  ON a.status = 'approved' AND a.max_altitude_ft >= b.altitude_ft AND a.start_time <= b.at AND a.end_time >= b.at
 AND {of.box_meets_sql('a', 'b.bx0', 'b.by0', 'b.bx1', 'b.by1')}""")
def q_auth_intersecting(spark, sf_dir):
    """Approved authorization areas meeting each box, with the altitude and activeAt filters."""
    out = spatial.intersecting_authorizations(fx.authorizations(spark, sf_dir),
                                              _boxes(spark, sf_dir).select("box_id", "box", "altitude_ft", "at"),
                                              alt_col="altitude_ft", at_col="at", status="approved")
    return out.select("box_id", F.col("a_authorization_id").alias("authorization_id"))


@query("plan_intersecting", with_fixtures("flight_plans", "waypoints") + f""",
{_BOX_SQL}
SELECT b.box_id, f.flight_plan_id FROM boxes b JOIN flight_plans f ON f.plan_type = 'polygon'
 AND f.start_time <= b.at AND f.end_time >= b.at AND f.cx - f.h <= b.bx1 AND f.cx + f.h >= b.bx0 AND f.cy - f.h <= b.by1 AND f.cy + f.h >= b.by0
UNION ALL
SELECT b.box_id, f.flight_plan_id FROM boxes b JOIN flight_plans f ON f.plan_type = 'waypoints'
 AND f.start_time <= b.at AND f.end_time >= b.at
WHERE EXISTS (SELECT 1 FROM waypoints w WHERE w.flight_plan_id = f.flight_plan_id
   AND {of.disc_meets_sql('w', 'b')})""")
def q_plan_intersecting(spark, sf_dir):
    """X5 with activeAt and no altitude: every plan active at the box's instant meeting it."""
    out = spatial.intersecting_flight_plans(fx.flight_plans(spark, sf_dir), fx.waypoints(spark, sf_dir),
                                            _boxes(spark, sf_dir).select("box_id", "box", "at"), at_col="at")
    return out.select("box_id", "flight_plan_id")


@query("contains_point", with_fixtures("live_positions", "zone_reports") + f"""
SELECT p.report_id, z.report_id AS zone_report_id, {contains_sql('p.longitude', 'p.latitude', 'z')} AS inside
FROM live_positions p JOIN zone_reports z ON z.event_id = p.event_id""")
def q_contains_point(spark, sf_dir):
    """Is each event's drone position strictly inside the zone polygon reported by the
    same event? One row per event, the predicate as a column (true and false both checked)."""
    pos = fx.live_positions(spark, sf_dir).select("report_id", "latitude", "longitude",
                                                  F.expr("substring(report_id, 3)").alias("_e"))
    z = fx.zone_reports(spark, sf_dir).select(F.col("report_id").alias("zone_report_id"), "rings",
                                              F.expr("substring(report_id, 3)").alias("_ze"))
    j = pos.join(z, F.col("_e") == F.col("_ze")).withColumn("_edges", F.expr(geo.edges_sql("rings")))
    j = j.withColumn("_sb", F.expr(geo.bbox_sql("rings")))
    return j.select("report_id", "zone_report_id",
                    covering.polygon_holds_point("_edges", "_sb", "longitude", "latitude").alias("inside"))


@query("polygon_box_intersects", with_fixtures("zone_reports") + f""",
{_BOX_SQL}
SELECT b.box_id, z.report_id, {of.box_meets_sql('z', 'b.bx0', 'b.by0', 'b.bx1', 'b.by1')} AS meets
FROM boxes b JOIN zone_reports z ON z.event_id = CAST(substr(b.box_id, 3) AS BIGINT)""")
def q_polygon_box_intersects(spark, sf_dir):
    """Does each event's search box meet (closed) the zone polygon of the same event?"""
    z = fx.zone_reports(spark, sf_dir).select("report_id", "rings", F.expr("substring(report_id, 3)").alias("_ze"))
    bx = _boxes(spark, sf_dir).select("box_id", "box", F.expr("substring(box_id, 3)").alias("_be"))
    j = bx.join(z, F.col("_ze") == F.col("_be")).withColumn("_edges", F.expr(geo.edges_sql("rings")))
    return j.select("box_id", "report_id", F.expr(geo.box_meets_edges_sql(
        "_edges", "box.min_lon", "box.min_lat", "box.max_lon", "box.max_lat")).alias("meets"))


@query("disc_box_intersects", with_fixtures("waypoints") + f""",
{_BOX_SQL}
SELECT b.box_id, w.flight_plan_id, w.sequence_number,
       {of.disc_meets_sql('w', 'b')} AS meets
FROM boxes b JOIN waypoints w ON w.flight_plan_id = 'FP-' || substr(b.box_id, 3)""")
def q_disc_box_intersects(spark, sf_dir):
    """Each event's box against the waypoint discs (radius in metres) of the plan with the
    same number."""
    w = fx.waypoints(spark, sf_dir)
    bx = _boxes(spark, sf_dir).select("box_id", "box",
                                      F.concat(F.lit("FP-"), F.expr("substring(box_id, 3)")).alias("_fp"))
    j = bx.join(w, F.col("flight_plan_id") == F.col("_fp"))
    bc = F.col("box")
    return j.select("box_id", "flight_plan_id", "sequence_number", geo.disc_box_intersects(
        F.col("lat"), F.col("lon"), F.col("radius_meters"), bc["min_lon"], bc["min_lat"], bc["max_lon"],
        bc["max_lat"]).alias("meets"))


# ============================================================ N1-N3

@query("active_sensors", with_fixtures("sensors", "sensor_profiles") + """
SELECT s.sensor_id, s.status FROM sensors s JOIN sensor_profiles p ON p.sensor_id = s.sensor_id""")
def q_active_sensors(spark, sf_dir):
    out = sn.active_sensors(fx.sensors(spark, sf_dir), fx.sensor_profiles_raw(spark, sf_dir))
    return out.select("sensor_id", "status")


@query("sensor_reconcile", """
WITH p AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS sensor_id, s_suppkey % 5 AS v FROM supplier WHERE s_suppkey % 3 <> 1),
c AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS sensor_id, s_suppkey % 7 AS v FROM supplier WHERE s_suppkey % 3 <> 2)
SELECT coalesce(p.sensor_id, c.sensor_id) AS sensor_id,
  CASE WHEN p.sensor_id IS NULL THEN 'start' WHEN c.sensor_id IS NULL THEN 'stop'
       WHEN p.v <> c.v THEN 'restart' ELSE 'keep' END AS action,
  CASE WHEN c.sensor_id IS NULL THEN 'offline' ELSE 'online' END AS status
FROM p FULL OUTER JOIN c ON p.sensor_id = c.sensor_id""")
def q_sensor_reconcile(spark, sf_dir):
    """A third of the suppliers is in both snapshots (versions key % 5 and key % 7), a third
    only in the current one and a third only in the previous one."""
    s = fx.load(spark, sf_dir, "supplier")
    sid = F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("sensor_id")
    prev = s.filter(F.col("s_suppkey") % 3 != 1).select(sid, (F.col("s_suppkey") % 5).alias("profile_version"))
    cur = s.filter(F.col("s_suppkey") % 3 != 2).select(sid, (F.col("s_suppkey") % 7).alias("profile_version"))
    return sn.sensor_reconcile(prev, cur)


@query("downsample_track", with_fixtures("live_positions") + f"""
SELECT drone_serial_number, strftime(to_timestamp(floor(epoch_us(recorded_at) / 21600000000) * 21600), '%Y-%m-%d %H:%M:%S.%f')
       AS window_start, report_id
FROM (SELECT *, row_number() OVER (PARTITION BY drone_serial_number, floor(epoch_us(recorded_at) / 21600000000)
                                   ORDER BY recorded_at, report_id) rn FROM live_positions) WHERE rn = 1""")
def q_downsample_track(spark, sf_dir):
    """First report per drone per 6-hour tumbling window."""
    out = sn.downsample_track(fx.live_positions(spark, sf_dir), "6 hours")
    return out.select("drone_serial_number", "window_start", "report_id")


@query("geojson_encode", with_fixtures("zone_reports") + """
SELECT report_id, 'Polygon' AS type, CAST(CASE shape WHEN 'holed' THEN 2 ELSE 1 END AS BIGINT) AS n_rings,
       CAST(CASE shape WHEN 'tri' THEN 4 ELSE 5 END AS BIGINT) AS n_shell FROM zone_reports""")
def q_geojson_encode(spark, sf_dir):
    """S8 encode: zone polygons to GeoJSON text, read back with JSON path functions."""
    z = fx.zone_reports(spark, sf_dir)
    txt = js.geojson_encode(F.col("rings"))
    return z.select("report_id", F.get_json_object(txt, "$.type").alias("type"),
                    F.json_array_length(F.get_json_object(txt, "$.coordinates")).cast("long").alias("n_rings"),
                    F.json_array_length(F.get_json_object(txt, "$.coordinates[0]")).cast("long").alias("n_shell"))
