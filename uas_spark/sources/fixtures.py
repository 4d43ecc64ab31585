"""Domain tables derived from the driver's test tables.

Every recipe is plain integer arithmetic on keys, with divisions by powers of
two, so the same values come out bit for bit in Spark and in the SQL oracle
(``uas_spark/plans/oracle_fixtures.py`` holds the same recipes in SQL).
All recipes keep every input row; none samples or caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.validate import ENUMS
from .tables import load

VISIBILITY_STATES, WIND_STATES = ENUMS["visibility_state"], ENUMS["wind_state"]
WAIVER_TYPES = ENUMS["waiver_type"]


def _k(c: str) -> Column:
    return F.col(c)


def _s(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), (c if isinstance(c, Column) else F.col(c)).cast("string"))


def _frac(expr: Column, denom: int) -> Column:
    return expr.cast("double") / F.lit(float(denom))


def _ts(base: str) -> Column:
    return F.to_timestamp(F.lit(base))


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts) + secs)


def _plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _status_of(orderstatus: Column) -> Column:
    return (F.when(orderstatus == "P", "proposed").when(orderstatus == "O", "approved")
            .otherwise("rescinded"))


# ----------------------------------------------------------------- flight logs

def live_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        _s("r-", "event_id").alias("report_id"),
        _s("SN-", "user_id").alias("drone_serial_number"),
        _k("ts").alias("recorded_at"),
        (F.lit(47.0) + _frac(_k("event_id") % 512, 1024)).alias("latitude"),
        (F.lit(-123.0) + _frac(_k("event_id") * 7 % 1024, 1024)).alias("longitude"),
        _k("value").alias("altitude_ft"),
        _k("ts").alias("ingested_at"),
    )


# Stored/incoming split for ingest jobs: a time cut, not a sample; the batch
# overlaps the stored range and is submitted twice (a full retry).
STORED_BEFORE = "2024-01-16 00:00:00"
BATCH_FROM = "2024-01-10 00:00:00"


def live_stored(spark, sf_dir) -> DataFrame:
    return live_positions(spark, sf_dir).filter(F.col("recorded_at") < _ts(STORED_BEFORE))


def live_batch(spark, sf_dir) -> DataFrame:
    """Incoming reports with arrival order: attempt 0, then the retry, by report."""
    b = live_positions(spark, sf_dir).filter(F.col("recorded_at") >= _ts(BATCH_FROM))
    return (b.withColumn("attempt", F.lit(0))
             .unionByName(b.withColumn("attempt", F.lit(1))))


def sensors(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    k = _k("s_suppkey")
    return s.select(
        _s("S-", k).alias("sensor_id"),
        _k("s_name").alias("name"),
        F.when(k % 2 == 1, F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
        (F.lit(47.0) + _frac(k * 37 % 512, 1024)).alias("latitude"),
        (F.lit(-123.0) + _frac(k * 101 % 1024, 1024)).alias("longitude"),
        (F.lit(1000.0) + (k % 10).cast("double") * 500).alias("sensing_radius_meters"),
        F.when(k % 2 == 0, "online").otherwise("offline").alias("status"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("updated_at"),
    )


def sensor_profiles_raw(spark, sf_dir) -> DataFrame:
    """A profile JSON text per supplier: of its sensor if the key is divisible by 3, else of a
    sensor that is no longer registered."""
    s = load(spark, sf_dir, "supplier")
    k = _k("s_suppkey")
    txt = F.concat(F.lit('{"pollIntervalMs":{"min":'), (F.lit(2000) + k % 7 * 100).cast("string"),
                   F.lit(',"max":5000},"latencyMs":{"min":200,"max":'), (F.lit(1000) + k % 5 * 100).cast("string"),
                   F.lit('},"label":"p'), k.cast("string"), F.lit('"}'))
    return s.select(_s("S-", F.when(k % 3 == 0, k).otherwise(k + 100000)).alias("sensor_id"), txt.alias("profile_json"),
                                       _plus_seconds(_ts("2023-12-02 00:00:00"), k).alias("created_at"))


def sensor_positions(spark, sf_dir) -> DataFrame:
    """Live reports seen by sensors; ids run past the supplier count so some are unknown."""
    e = load(spark, sf_dir, "events")
    # scalar subquery: the supplier count, evaluated once
    n_sup = load(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    return (e.withColumn("n_sup", n_sup)
             .select(
                 _s("r-", "event_id").alias("report_id"),
                 _s("SN-", "user_id").alias("drone_serial_number"),
                 _s("S-", _k("event_id") % (_k("n_sup") + 5)).alias("sensor_id"),
                 _k("ts").alias("recorded_at"),
                 (F.lit(47.0) + _frac(_k("event_id") % 512, 1024)).alias("latitude"),
                 (F.lit(-123.0) + _frac(_k("event_id") * 7 % 1024, 1024)).alias("longitude"),
                 _k("value").alias("altitude_ft"),
                 _k("ts").alias("ingested_at"),
                 (_k("event_id") / 50).cast("long").alias("batch_id"),
             ))


# ----------------------------------------------------------------- weather zones

def _zone_shape_sql() -> str:
    """Zone polygon of an event: a box, every 4th a triangle, every 8th (odd) a box with a hole."""
    cx = "(-123.0D + CAST(event_id * 13 % 1024 AS DOUBLE) / 1024.0D)"
    cy = "(47.0D + CAST(event_id * 5 % 512 AS DOUBLE) / 1024.0D)"
    h = "(CAST(8 + event_id % 25 AS DOUBLE) / 256.0D)"
    g = f"({h} / 2)"
    tri = geo.ring_sql([(f"{cx} - {h}", f"{cy} - {h}"), (f"{cx} + {h}", f"{cy} - {h}"), (cx, f"{cy} + {h}")])
    box = geo.ring_sql([(f"{cx} - {h}", f"{cy} - {h}"), (f"{cx} + {h}", f"{cy} - {h}"),
                        (f"{cx} + {h}", f"{cy} + {h}"), (f"{cx} - {h}", f"{cy} + {h}")])
    hole = geo.ring_sql([(f"{cx} - {g}", f"{cy} - {g}"), (f"{cx} - {g}", f"{cy} + {g}"),
                         (f"{cx} + {g}", f"{cy} + {g}"), (f"{cx} + {g}", f"{cy} - {g}")])
    return (f"CASE WHEN event_id % 4 = 0 THEN array({tri}) WHEN event_id % 8 = 1 THEN array({box}, {hole}) "
            f"ELSE array({box}) END")


def zone_reports(spark, sf_dir, layer: str = "visibility") -> DataFrame:
    """All zone reports of one layer, observed and forecast (``kind`` column).

    Observed reports are stamped at the event time. Forecasts target the hour of the
    event (so several forecasts share a target instant) and were issued
    ``event_id % 7`` hours before it.
    """
    e = load(spark, sf_dir, "events")
    eid = _k("event_id")
    observed = _k("event_type").isin("view", "click", "signup")
    target = F.when(observed, _k("ts")).otherwise(F.date_trunc("hour", _k("ts")))
    cols = [
        _s("z-", eid).alias("report_id"),
        _s("Z-", _k("user_id") % 20).alias("zone_id"),
        F.when(observed, "observed").otherwise("forecast").alias("kind"),
        target.alias("recorded_at"),
    ]
    if layer == "visibility":
        state = _pick(VISIBILITY_STATES, eid % 5)
        cols += [state.alias("state"),
                 F.when(eid % 5 == 2, _k("value") * 10).cast("double").alias("ceiling_ft")]
    else:
        cols += [_pick(WIND_STATES, eid % 4).alias("state")]
    cols += [F.expr(_zone_shape_sql()).alias("rings"),
             F.when(observed, _k("ts")).otherwise(_plus_hours(_k("ts"), -(eid % 7))).alias("ingested_at")]
    return e.select(*cols)


def observed_reports(spark, sf_dir, layer="visibility") -> DataFrame:
    return zone_reports(spark, sf_dir, layer).filter(F.col("kind") == "observed").drop("kind")


def forecast_reports(spark, sf_dir, layer="visibility") -> DataFrame:
    return zone_reports(spark, sf_dir, layer).filter(F.col("kind") == "forecast").drop("kind")


# ----------------------------------------------------------------- registry

def owners(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    k = _k("c_custkey")
    org = _k("c_mktsegment") == "BUILDING"
    return c.select(
        _s("O-", k).alias("owner_id"),
        F.when(org, "organization").otherwise("individual").alias("owner_type"),
        F.when(org, _k("c_name")).alias("company_name"),
        _s("First", k).alias("first_name"),
        _k("c_name").alias("last_name"),
        _s("+1-555-", k).alias("phone_number"),
        _s("Street ", k).alias("address_line1"),
        F.when(k % 2 == 0, _s("Unit ", k)).alias("address_line2"),
        _s("City ", _k("c_nationkey")).alias("address_city"),
        F.lit("WA").alias("address_state"),
        _s("98", k % 1000).alias("address_zip"),
        F.concat(F.lit("o"), k.cast("string"), F.lit("@example.com")).alias("email"),
        _plus_seconds(_ts("2025-01-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2025-01-01 00:00:00"), k).alias("updated_at"),
    )


def pilots(spark, sf_dir) -> DataFrame:
    """A pilot per customer, claimed under owner ``c_custkey % 1000``. Plans and waivers refer to
    keys divisible by three; the others fly under ids of their own series."""
    c = load(spark, sf_dir, "customer")
    k = _k("c_custkey")
    return c.select(
        F.when(k % 3 == 0, _s("P-", k)).otherwise(_s("PX-", k)).alias("pilot_id"),
        _s("O-", k % 1000).alias("organization_owner_id"),
        _k("c_name").alias("name"),
        _s("+1-555-", k).alias("phone_number"),
        _s("LIC-", k).alias("license_number"),
        _plus_seconds(_ts("2025-02-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2025-02-01 00:00:00"), k).alias("updated_at"),
    )


def registrations(spark, sf_dir) -> DataFrame:
    """One registration request per order, in ``o_orderkey`` arrival order."""
    o = load(spark, sf_dir, "orders")
    k = _k("o_orderkey")
    start = F.date_add(F.to_date(F.lit("2023-09-01")), (k % 180).cast("int"))
    return o.select(
        _s("R-", k).alias("registration_id"),
        _s("SN-", (_k("o_custkey") / 10).cast("long")).alias("serial_number"),
        F.lit("Acme").alias("make"),
        _s("M", k % 13).alias("model_number"),
        _s("O-", "o_custkey").alias("owner_id"),
        start.alias("start_date"),
        F.date_add(start, (k % 60).cast("int")).alias("end_date"),
        _plus_seconds(_ts("2023-08-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2023-08-01 00:00:00"), k).alias("updated_at"),
        k.alias("arrival"),
    )


# ----------------------------------------------------------------- authorizations

def _auth_area_sql() -> str:
    """Authorization area of an order: a box, every 3rd a triangle."""
    cx = "(-123.0D + CAST(o_orderkey * 29 % 1024 AS DOUBLE) / 1024.0D)"
    cy = "(47.0D + CAST(o_orderkey * 11 % 512 AS DOUBLE) / 1024.0D)"
    h = "(CAST(1 + o_orderkey % 8 AS DOUBLE) / 128.0D)"
    tri = geo.ring_sql([(f"{cx} - {h}", f"{cy} - {h}"), (f"{cx} + {h}", f"{cy} - {h}"), (cx, f"{cy} + {h}")])
    box = geo.ring_sql([(f"{cx} - {h}", f"{cy} - {h}"), (f"{cx} + {h}", f"{cy} - {h}"),
                        (f"{cx} + {h}", f"{cy} + {h}"), (f"{cx} - {h}", f"{cy} + {h}")])
    return f"CASE WHEN o_orderkey % 3 = 0 THEN array({tri}) ELSE array({box}) END"


def _window(k: Column, offset_hours: int = 0):
    start = _plus_hours(_ts("2024-01-01 00:00:00"), (k % 720) + offset_hours)
    return start, _plus_hours(start, F.lit(1) + k % 12)


def authorizations(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = _k("o_orderkey")
    status = _status_of(_k("o_orderstatus"))
    start, end = _window(k)
    return o.select(
        _s("A-", k).alias("authorization_id"),
        F.expr(_auth_area_sql()).alias("area"),
        (k % 2001).cast("double").alias("max_altitude_ft"),
        start.alias("start_time"), end.alias("end_time"),
        _s("O-", "o_custkey").alias("owner_id"),
        F.when(k % 2 == 0, _s("P-", _k("o_custkey") - _k("o_custkey") % 3)).alias("pilot_id"),
        status.alias("status"),
        F.when(status == "rescinded", start).alias("rescinded_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("updated_at"),
    )


def flight_plans(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = _k("o_orderkey")
    is_wp = k % 2 == 0
    start, end = _window(k, 3)
    cx = "(-123.0D + CAST(o_orderkey * 37 % 1024 AS DOUBLE) / 1024.0D)"
    cy = "(47.0D + CAST(o_orderkey * 3 % 512 AS DOUBLE) / 1024.0D)"
    h = "(CAST(1 + o_orderkey % 4 AS DOUBLE) / 128.0D)"
    box = F.expr(geo.ring_sql([(f"{cx} - {h}", f"{cy} - {h}"), (f"{cx} + {h}", f"{cy} - {h}"),
                               (f"{cx} + {h}", f"{cy} + {h}"), (f"{cx} - {h}", f"{cy} + {h}")]))
    reg = (F.when(k % 4 == 0, F.lit(None).cast("string"))
            .when(k % 4 == 1, _s("R-", k))
            .when(k % 4 == 2, _s("R-", k + 1))
            .otherwise(_s("R-X", k)))
    return o.select(
        _s("FP-", k).alias("flight_plan_id"),
        F.when(is_wp, "waypoints").otherwise("polygon").alias("plan_type"),
        _s("O-", "o_custkey").alias("owner_id"),
        reg.alias("registration_id"),
        F.when(k % 3 == 0, _s("P-", _k("o_custkey") - _k("o_custkey") % 3)).alias("pilot_id"),
        F.when(k % 5 == 0, _s("A-", k)).when(k % 5 == 1, _s("A-X", k)).alias("airspace_authorization_id"),
        start.alias("start_time"), end.alias("end_time"),
        F.when(~is_wp, F.array(box)).alias("polygon_area"),
        F.when(~is_wp, (k % 2001).cast("double")).alias("polygon_max_altitude_ft"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("updated_at"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_pairs(spark, sf_dir, group: tuple[str, str] | None = None) -> DataFrame:
    """Every order line, numbered anew from 1 within its order (stored numbers repeat). ``group``: name and
    SQL of a column that an order's lines share; the lines are dealt by it, for what follows too."""
    from pyspark.sql import Window
    lines = load(spark, sf_dir, "lineitem")
    by, more = ["l_orderkey"], []
    if group is not None:
        name, sql = group
        lines = lines.select("l_orderkey", *LINE_ORDER, F.expr(sql).alias(name)).repartition(name)
        by, more = [name, "l_orderkey"], [name]
    w = Window.partitionBy(*by).orderBy(*LINE_ORDER)
    return lines.select(
        *more, "l_orderkey", F.row_number().over(w).alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity",
        "l_returnflag", "l_linestatus")


def waypoints(spark, sf_dir) -> DataFrame:
    """Waypoints of the waypoint plans (even order keys), numbered from 0. The lines of an odd
    order belong to the plan of the next even key, after which theirs are numbered."""
    from pyspark.sql import Window
    p = lineitem_pairs(spark, sf_dir, ("plan_key", "l_orderkey + l_orderkey % 2"))
    w = Window.partitionBy("plan_key").orderBy("l_orderkey", "l_linenumber")
    pk, ln = _k("l_partkey"), _k("l_linenumber")
    lo = _k("l_quantity") * 4
    return p.select(
        _s("FP-", "plan_key").alias("flight_plan_id"),
        (F.row_number().over(w) - 1).cast("int").alias("sequence_number"),
        (F.lit(47.0) + _frac(pk * 3 % 512, 1024)).alias("lat"),
        (F.lit(-123.0) + _frac((pk * 7 + ln * 131) % 1024, 1024)).alias("lon"),
        lo.alias("altitude_min_ft"),
        (lo + 100).alias("altitude_max_ft"),
        (ln * 200).cast("double").alias("radius_meters"),
    )


def waivers(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = _k("o_orderkey")
    status = _status_of(_k("o_orderstatus"))
    start, end = _window(k, 6)
    return o.select(
        _s("WV-", k).alias("waiver_id"),
        _pick(WAIVER_TYPES, k % 4).alias("waiver_type"),
        F.when(k % 2 == 0, _s("P-", _k("o_custkey") - _k("o_custkey") % 3)).alias("pilot_id"),
        F.when(k % 2 == 1, _s("O-", "o_custkey")).alias("owner_id"),
        _k("o_orderpriority").alias("conditions"),
        start.alias("start_time"), end.alias("end_time"),
        status.alias("status"),
        F.when(status == "rescinded", start).alias("rescinded_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("created_at"),
        _plus_seconds(_ts("2023-12-01 00:00:00"), k).alias("updated_at"),
    )


def lifecycle_patches(spark, sf_dir, prefix: str = "A-") -> DataFrame:
    """Patches against authorizations (or waivers): id from l_orderkey, order by line number.

    Return flag R asks to rescind, A to approve, N leaves status alone; open lines
    (linestatus O) also set a field, and every fifth part number lists ``pilotId``, so some rescinds
    are not pure: with a null, with the pilot of the owner's own number or with another's. Three of
    seven part numbers give a start, an end or both, often an end before the start.
    """
    p = lineitem_pairs(spark, sf_dir, ("target_id", f"concat('{prefix}', CAST(l_orderkey AS STRING))"))
    status = F.when(_k("l_returnflag") == "R", "rescinded").when(_k("l_returnflag") == "A", "approved")
    m, t0 = _k("l_partkey") % 7, _ts("2024-01-01 00:00:00")
    return p.select(
        "target_id",
        _k("l_linenumber").cast("long").alias("seq"),
        status.alias("status"),
        F.when(_k("l_linestatus") == "O", _k("l_quantity") * 10).alias("max_altitude_ft"),
        (_k("l_partkey") % 5 == 0).alias("pilot_present"),
        F.when(_k("l_partkey") % 15 == 5, "own").when(_k("l_partkey") % 15 == 10, _s("P-", "l_partkey")).alias("pilot_pick"),
        F.when(m.isin(3, 6), _plus_seconds(t0, (_k("l_suppkey") * 13 + _k("l_linenumber") * 5) % 720 * 3600)).alias("start_time"),
        F.when(m.isin(5, 6), _plus_seconds(t0, (_k("l_suppkey") * 17 + _k("l_linenumber") * 7) % 760 * 3600)).alias("end_time"),
    )
