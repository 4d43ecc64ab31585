"""Registered queries: each key of SURVEY section 2 as a Spark job over the test tables,
with its DuckDB oracle.

Every query derives its inputs from whole test tables (``sources.fixtures``), runs one
library operator, and returns plain columns: instants and dates as text (see
``functions.timefn.texts_for_instants``), so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, solar
from ..functions.timefn import texts_for_instants
from ..operators import asof, spatial
from ..sources import fixtures as fx
from . import oracle_fixtures as of
from .oracle_fixtures import contains_sql, iso, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
AT = "2024-01-20 12:00:00"
FORECAST_AT = "2024-01-20 12:20:00"
STAMP = "2024-01-20 12:00:00"


def query(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: texts_for_instants(fn(spark, sf_dir))
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _points(spark, sf_dir) -> DataFrame:
    """Point probes: every live position report, as (probe_id, lat, lon)."""
    return fx.live_positions(spark, sf_dir).select(F.col("report_id").alias("probe_id"),
                                                   F.col("latitude").alias("lat"),
                                                   F.col("longitude").alias("lon"))


_POINTS_SQL = "points AS (SELECT report_id AS probe_id, latitude AS lat, longitude AS lon FROM live_positions)"


# ============================================================ flagship: X1 as-of

@query("zone_observed_at_point", with_fixtures("live_positions", "observed_reports") + f""",
{_POINTS_SQL},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
                        FROM observed_reports WHERE recorded_at <= TIMESTAMP '{AT}') WHERE rn = 1)
SELECT p.probe_id, z.zone_id, z.report_id, z.state
FROM points p JOIN pick z ON {contains_sql('p.lon', 'p.lat', 'z')}""")
def q_zone_observed_at_point(spark, sf_dir):
    out = spatial.zone_observed_at_point(fx.observed_reports(spark, sf_dir), _points(spark, sf_dir), at=AT)
    return out.select("probe_id", F.col("z_zone_id").alias("zone_id"), F.col("z_report_id").alias("report_id"),
                      F.col("z_state").alias("state"))


@query("zone_observed_latest_at_point", with_fixtures("live_positions", "observed_reports") + f""",
{_POINTS_SQL},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
                        FROM observed_reports WHERE recorded_at >= TIMESTAMP '{STAMP}' - INTERVAL 180 MINUTE)
         WHERE rn = 1)
SELECT p.probe_id, z.zone_id, z.report_id, z.state
FROM points p JOIN pick z ON {contains_sql('p.lon', 'p.lat', 'z')}""")
def q_zone_observed_latest_at_point(spark, sf_dir):
    out = spatial.zone_observed_at_point(fx.observed_reports(spark, sf_dir), _points(spark, sf_dir), stamp=STAMP,
                                         stale_minutes=180)
    return out.select("probe_id", F.col("z_zone_id").alias("zone_id"), F.col("z_report_id").alias("report_id"),
                      F.col("z_state").alias("state"))


# ============================================================ T1-T4

@query("latest_position", with_fixtures("live_positions") + f"""
SELECT drone_serial_number, report_id, {iso('recorded_at')} AS recorded_at, latitude, longitude
FROM (SELECT *, row_number() OVER (PARTITION BY drone_serial_number ORDER BY recorded_at DESC, report_id) rn
      FROM live_positions) WHERE rn = 1""")
def q_latest_position(spark, sf_dir):
    return asof.latest_position(fx.live_positions(spark, sf_dir)).select(
        "drone_serial_number", "report_id", "recorded_at", "latitude", "longitude")


_ZONE_OUT = "zone_id, report_id, {r} AS recorded_at, state, ceiling_ft"


@query("zone_latest_fresh", with_fixtures("observed_reports") + f"""
SELECT {_ZONE_OUT.format(r=iso('recorded_at'))}
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
      FROM observed_reports WHERE recorded_at >= TIMESTAMP '{STAMP}' - INTERVAL 30 MINUTE) WHERE rn = 1""")
def q_zone_latest_fresh(spark, sf_dir):
    return asof.zone_latest_fresh(fx.observed_reports(spark, sf_dir), STAMP, 30).select(
        "zone_id", "report_id", "recorded_at", "state", "ceiling_ft")


@query("zone_asof", with_fixtures("observed_reports") + f"""
SELECT {_ZONE_OUT.format(r=iso('recorded_at'))}
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY recorded_at DESC, report_id) rn
      FROM observed_reports WHERE recorded_at <= TIMESTAMP '{AT}') WHERE rn = 1""")
def q_zone_asof(spark, sf_dir):
    return asof.zone_asof(fx.observed_reports(spark, sf_dir), AT).select(
        "zone_id", "report_id", "recorded_at", "state", "ceiling_ft")


@query("zone_forecast_nearest", with_fixtures("forecast_reports") + f"""
SELECT {_ZONE_OUT.format(r=iso('recorded_at'))}, {iso('ingested_at')} AS ingested_at
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id
        ORDER BY abs(epoch_us(recorded_at) - epoch_us(TIMESTAMP '{FORECAST_AT}')), ingested_at DESC, report_id) rn
      FROM forecast_reports) WHERE rn = 1""")
def q_zone_forecast_nearest(spark, sf_dir):
    return asof.zone_forecast_nearest(fx.forecast_reports(spark, sf_dir), FORECAST_AT).select(
        "zone_id", "report_id", "recorded_at", "state", "ceiling_ft", "ingested_at")


# ============================================================ P1, P2: keyed probe joins

def _zone_time_probes(spark, sf_dir) -> DataFrame:
    """(probe_id, zone_id, at) for every event: zone by event id, time = event time."""
    e = fx.load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("probe_id"),
                    F.concat(F.lit("Z-"), (F.col("event_id") % 20).cast("string")).alias("zone_id"),
                    F.col("ts").alias("at"))


_ZPROBES_SQL = ("zprobes AS (SELECT 'q-' || CAST(event_id AS VARCHAR) AS probe_id, "
                "'Z-' || CAST(event_id % 20 AS VARCHAR) AS zone_id, ts AS at FROM events)")


@query("join_zone_asof", with_fixtures("observed_reports") + f""",
{_ZPROBES_SQL}
SELECT p.probe_id, p.zone_id, {iso('p.at')} AS probe_at, o.report_id, o.state
FROM zprobes p ASOF LEFT JOIN observed_reports o ON p.zone_id = o.zone_id AND o.recorded_at <= p.at""")
def q_join_zone_asof(spark, sf_dir):
    out = asof.join_zone_asof(_zone_time_probes(spark, sf_dir), fx.observed_reports(spark, sf_dir).select(
        "zone_id", "recorded_at", "report_id", "state", "ingested_at"))
    return out.select("probe_id", "zone_id", F.col("at").alias("probe_at"), F.col("rep.report_id").alias("report_id"),
                      F.col("rep.state").alias("state"))


_INSTANTS_SQL = """inst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, recorded_at
                   ORDER BY ingested_at DESC, report_id) rn FROM forecast_reports) WHERE rn = 1)"""


@query("join_zone_forecast_nearest", with_fixtures("forecast_reports") + f""",
{_ZPROBES_SQL}, {_INSTANTS_SQL},
b AS (SELECT p.*, i.report_id AS b_id, i.recorded_at AS b_t, i.ingested_at AS b_ing, i.state AS b_state
      FROM zprobes p ASOF LEFT JOIN inst i ON p.zone_id = i.zone_id AND i.recorded_at <= p.at),
f AS (SELECT p.probe_id, i.report_id AS f_id, i.recorded_at AS f_t, i.ingested_at AS f_ing, i.state AS f_state
      FROM zprobes p ASOF LEFT JOIN inst i ON p.zone_id = i.zone_id AND i.recorded_at >= p.at),
j AS (SELECT b.*, f.f_id, f.f_t, f.f_ing, f.f_state,
             epoch_us(b.at) - epoch_us(b.b_t) AS dp, epoch_us(f.f_t) - epoch_us(b.at) AS dn
      FROM b JOIN f USING (probe_id))
SELECT probe_id, zone_id, {iso('j.at')} AS probe_at,
       CASE WHEN f_id IS NULL OR (b_id IS NOT NULL AND (dp < dn OR (dp = dn AND (b_ing > f_ing OR (b_ing = f_ing AND b_id <= f_id)))))
            THEN b_id ELSE f_id END AS report_id,
       CASE WHEN f_id IS NULL OR (b_id IS NOT NULL AND (dp < dn OR (dp = dn AND (b_ing > f_ing OR (b_ing = f_ing AND b_id <= f_id)))))
            THEN b_state ELSE f_state END AS state
FROM j""")
def q_join_zone_forecast_nearest(spark, sf_dir):
    out = asof.join_zone_forecast_nearest(
        _zone_time_probes(spark, sf_dir), fx.forecast_reports(spark, sf_dir).select(
            "zone_id", "recorded_at", "report_id", "state", "ingested_at"))
    return out.select("probe_id", "zone_id", F.col("at").alias("probe_at"), F.col("rep.report_id").alias("report_id"),
                      F.col("rep.state").alias("state"))


# ============================================================ P7, P8: positions against zones

@query("join_positions_zone_current", with_fixtures("live_positions", "observed_reports") + f""",
zones AS (SELECT DISTINCT zone_id FROM observed_reports),
pz AS (SELECT p.report_id AS position_id, p.recorded_at, p.latitude, p.longitude, z.zone_id
       FROM live_positions p, zones z),
hit AS (SELECT pz.*, o.report_id, o.state, o.cx, o.cy, o.h, o.shape
        FROM pz ASOF JOIN observed_reports o ON pz.zone_id = o.zone_id AND o.recorded_at <= pz.recorded_at)
SELECT position_id, zone_id, report_id, state FROM hit o
WHERE {contains_sql('o.longitude', 'o.latitude', 'o')}""")
def q_join_positions_zone_current(spark, sf_dir):
    out = spatial.join_positions_zone_current(fx.live_positions(spark, sf_dir), fx.observed_reports(spark, sf_dir))
    return out.select(F.col("report_id").alias("position_id"), F.col("z_zone_id").alias("zone_id"),
                      F.col("z_report_id").alias("report_id"), F.col("z_state").alias("state"))


@query("join_positions_forecast_zone", with_fixtures("live_positions", "forecast_reports") + f""",
{_INSTANTS_SQL},
zones AS (SELECT DISTINCT zone_id FROM forecast_reports),
pz AS (SELECT p.report_id AS position_id, p.recorded_at AS at, p.latitude, p.longitude, z.zone_id
       FROM live_positions p, zones z),
b AS (SELECT pz.*, i.report_id AS b_id, i.recorded_at AS b_t, i.ingested_at AS b_ing
      FROM pz ASOF LEFT JOIN inst i ON pz.zone_id = i.zone_id AND i.recorded_at <= pz.at),
f AS (SELECT pz.position_id, pz.zone_id, i.report_id AS f_id, i.recorded_at AS f_t, i.ingested_at AS f_ing
      FROM pz ASOF LEFT JOIN inst i ON pz.zone_id = i.zone_id AND i.recorded_at >= pz.at),
j AS (SELECT b.*, f.f_id, f.f_t, f.f_ing, epoch_us(b.at) - epoch_us(b.b_t) AS dp, epoch_us(f.f_t) - epoch_us(b.at) AS dn
      FROM b JOIN f USING (position_id, zone_id)),
pick AS (SELECT position_id, zone_id, latitude, longitude,
       CASE WHEN f_id IS NULL OR (b_id IS NOT NULL AND (dp < dn OR (dp = dn AND (b_ing > f_ing OR (b_ing = f_ing AND b_id <= f_id)))))
            THEN b_id ELSE f_id END AS report_id FROM j)
SELECT k.position_id, k.zone_id, k.report_id, o.state
FROM pick k JOIN forecast_reports o ON o.report_id = k.report_id
WHERE {contains_sql('k.longitude', 'k.latitude', 'o')}""")
def q_join_positions_forecast_zone(spark, sf_dir):
    out = spatial.join_positions_forecast_zone(fx.live_positions(spark, sf_dir), fx.forecast_reports(spark, sf_dir))
    return out.select(F.col("report_id").alias("position_id"), F.col("z_zone_id").alias("zone_id"),
                      F.col("z_report_id").alias("report_id"), F.col("z_state").alias("state"))


# ============================================================ P4: positions covered by authorizations

@query("join_positions_covering_auth", with_fixtures("live_positions", "authorizations") + f"""
SELECT p.report_id AS position_id, a.authorization_id, a.status
FROM live_positions p JOIN authorizations a
  ON p.recorded_at >= a.start_time AND p.recorded_at <= a.end_time
 AND a.max_altitude_ft >= p.altitude_ft
 AND {contains_sql('p.longitude', 'p.latitude', 'a')}""")
def q_join_positions_covering_auth(spark, sf_dir):
    pos = fx.live_positions(spark, sf_dir).select("report_id", "recorded_at", "latitude", "longitude", "altitude_ft")
    out = spatial.covering_authorizations(fx.authorizations(spark, sf_dir), pos, at_col="recorded_at",
                                          alt_col="altitude_ft", lon="longitude", lat="latitude")
    return out.select(F.col("report_id").alias("position_id"), F.col("a_authorization_id").alias("authorization_id"),
                      F.col("a_status").alias("status"))


# ============================================================ P5: boxes against flight plans

def _event_boxes(spark, sf_dir) -> DataFrame:
    """One search box per event: corners given in either order, altitude and instant."""
    e = fx.load(spark, sf_dir, "events")
    eid = F.col("event_id")
    cx = F.lit(-123.0) + (eid * 19 % 1024).cast("double") / 1024.0
    cy = F.lit(47.0) + (eid * 23 % 512).cast("double") / 1024.0
    h = (F.lit(1) + eid % 4).cast("double") / 256.0
    flip = eid % 2 == 1
    lat1 = F.when(flip, cy + h).otherwise(cy - h)
    lat2 = F.when(flip, cy - h).otherwise(cy + h)
    return e.select(F.concat(F.lit("b-"), eid.cast("string")).alias("box_id"),
                    geo.normalize_box(lat1, cx - h, lat2, cx + h).alias("box"),
                    (F.col("value") * 5).alias("altitude_ft"), F.col("ts").alias("at"))


_BOXES_SQL = """boxes AS (SELECT 'b-' || CAST(event_id AS VARCHAR) AS box_id,
  -123.0::DOUBLE + CAST(event_id * 19 % 1024 AS DOUBLE) / 1024.0 - CAST(1 + event_id % 4 AS DOUBLE) / 256.0 AS bx0,
  47.0::DOUBLE + CAST(event_id * 23 % 512 AS DOUBLE) / 1024.0 - CAST(1 + event_id % 4 AS DOUBLE) / 256.0 AS by0,
  -123.0::DOUBLE + CAST(event_id * 19 % 1024 AS DOUBLE) / 1024.0 + CAST(1 + event_id % 4 AS DOUBLE) / 256.0 AS bx1,
  47.0::DOUBLE + CAST(event_id * 23 % 512 AS DOUBLE) / 1024.0 + CAST(1 + event_id % 4 AS DOUBLE) / 256.0 AS by1,
  value * 5 AS altitude_ft, ts AS at FROM events)"""


@query("join_boxes_flight_plans", with_fixtures("flight_plans", "waypoints") + f""",
{_BOXES_SQL}
SELECT b.box_id, f.flight_plan_id, f.plan_type, {iso('f.created_at')} AS created_at
FROM boxes b JOIN flight_plans f
  ON f.plan_type = 'polygon' AND f.start_time <= b.at AND f.end_time >= b.at
 AND f.polygon_max_altitude_ft >= b.altitude_ft
 AND f.cx - f.h <= b.bx1 AND f.cx + f.h >= b.bx0 AND f.cy - f.h <= b.by1 AND f.cy + f.h >= b.by0
UNION ALL
SELECT b.box_id, f.flight_plan_id, f.plan_type, {iso('f.created_at')} AS created_at
FROM boxes b JOIN flight_plans f ON f.plan_type = 'waypoints' AND f.start_time <= b.at AND f.end_time >= b.at
WHERE EXISTS (SELECT 1 FROM waypoints w WHERE w.flight_plan_id = f.flight_plan_id
   AND b.altitude_ft > w.altitude_min_ft AND b.altitude_ft <= w.altitude_max_ft
   AND {of.disc_meets_sql('w', 'b')})""")
def q_join_boxes_flight_plans(spark, sf_dir):
    out = spatial.intersecting_flight_plans(fx.flight_plans(spark, sf_dir), fx.waypoints(spark, sf_dir),
                                            _event_boxes(spark, sf_dir), alt_col="altitude_ft", at_col="at")
    return out.select("box_id", "flight_plan_id", "plan_type", "created_at")


# ============================================================ X12: sensor coverage

@query("sensor_coverage", with_fixtures("sensors", "live_positions") + f"""
SELECT s.sensor_id, p.report_id FROM sensors s JOIN live_positions p
  ON {of.haversine_sql('s.latitude', 's.longitude', 'p.latitude', 'p.longitude')} <= s.sensing_radius_meters""")
def q_sensor_coverage(spark, sf_dir):
    out = spatial.sensor_coverage(fx.sensors(spark, sf_dir), fx.live_positions(spark, sf_dir))
    return out.select(F.col("s_sensor_id").alias("sensor_id"), "report_id")


# ============================================================ C1: sun times for every report

def _sun_oracle() -> str:
    """The NOAA refinement written in SQL: one CTE per round, four events per round."""
    from ..functions import solar as so
    (c1, c1a, c1b), (c2, c2a), c3 = so.CENTRE
    a, b, s0, s1, s2, s3, corr = so.OBLIQUITY
    events = [("dawn", so.CIVIL_ALT_DEG, -1), ("sunrise", so.SUNRISE_ALT_DEG, -1),
              ("sunset", so.SUNRISE_ALT_DEG, 1), ("dusk", so.CIVIL_ALT_DEG, 1)]

    def step(t, alt, sign):
        T = f"((jd + {t} / 1440.0) - {so.J2000}) / 36525.0"
        l0 = f"radians(fmod(fmod({so.MEAN_LONG[0]} + ({T}) * ({so.MEAN_LONG[1]} + ({T}) * {so.MEAN_LONG[2]}), 360.0) + 360.0, 360.0))"
        m = f"radians({so.MEAN_ANOM[0]} + ({T}) * ({so.MEAN_ANOM[1]} - ({T}) * {so.MEAN_ANOM[2]}))"
        e = f"({so.ECCENTRICITY[0]} - ({T}) * ({so.ECCENTRICITY[1]} + ({T}) * {so.ECCENTRICITY[2]}))"
        c = (f"(sin({m}) * ({c1} - ({T}) * ({c1a} + ({T}) * {c1b})) + sin(2 * {m}) * ({c2} - ({T}) * {c2a})"
             f" + sin(3 * {m}) * {c3})")
        om = f"radians({so.OMEGA[0]} - ({T}) * {so.OMEGA[1]})"
        eps0 = f"({a} + ({b} + ({s0} - ({T}) * ({s1} + ({T}) * ({s2} - ({T}) * {s3}))) / 60.0) / 60.0)"
        eps = f"radians({eps0} + cos({om}) * {corr})"
        lam = f"radians(degrees({l0}) + {c} - {so.APPARENT[0]} - {so.APPARENT[1]} * sin({om}))"
        y = f"pow(tan({eps} / 2), 2)"
        dec = f"asin(sin({eps}) * sin({lam}))"
        eqt = (f"4 * degrees({y} * sin(2 * {l0}) - 2 * {e} * sin({m}) + 4 * {e} * {y} * sin({m}) * cos(2 * {l0})"
               f" - 0.5 * {y} * {y} * sin(4 * {l0}) - 1.25 * {e} * {e} * sin(2 * {m}))")
        cosh = f"((sin(radians({alt})) - sin(phi) * sin({dec})) / (cos(phi) * cos({dec})))"
        return (f"CASE WHEN isnan({t}) OR abs({cosh}) > 1 THEN 'NaN'::DOUBLE ELSE "
                f"720.0 - 4 * lon + (-({eqt})) + ({sign}) * 4 * degrees(acos({cosh})) END")

    ctes = ["p0 AS (SELECT report_id, epoch_ms(CAST(CAST(recorded_at AS DATE) AS TIMESTAMP)) AS d0, "
            "epoch_ms(CAST(CAST(recorded_at AS DATE) AS TIMESTAMP)) / 86400000.0 + 2440587.5 AS jd, "
            "radians(latitude) AS phi, longitude AS lon, "
            + ", ".join(f"720.0 - 4 * longitude AS {n}" for n, _, _ in events) + " FROM live_positions)"]
    for r in range(1, so.ITERATIONS + 1):
        cols = ", ".join(f"{step(n, alt, sg)} AS {n}" for n, alt, sg in events)
        ctes.append(f"p{r} AS (SELECT report_id, d0, jd, phi, lon, {cols} FROM p{r - 1})")
    last = f"p{so.ITERATIONS}"
    out = ", ".join(f"CASE WHEN isnan({n}) THEN NULL ELSE strftime(make_timestamp(CAST(floor(d0 + {n} * 60000.0) "
                    f"AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S') END AS {n}" for n, _, _ in events)
    return with_fixtures("live_positions") + ", " + ", ".join(ctes) + f" SELECT report_id, {out} FROM {last}"


@query("sun_times", _sun_oracle())
def q_sun_times(spark, sf_dir):
    pos = fx.live_positions(spark, sf_dir).select("report_id", F.to_date("recorded_at").alias("date"),
                                                  F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    out = solar.sun_times(pos)
    return out.select("report_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
                                     for c in ("dawn", "sunrise", "sunset", "dusk")])


# The remaining registrations live in sibling modules; importing them fills QUERIES/ORACLE.
from . import registry_writes  # noqa: E402,F401

from . import registry_reads  # noqa: E402,F401
from . import registry_streams  # noqa: E402,F401
from . import registry_bodies  # noqa: E402,F401
from . import registry_wind  # noqa: E402,F401
