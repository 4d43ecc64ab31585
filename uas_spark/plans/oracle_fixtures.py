"""The domain-table recipes of ``sources/fixtures.py`` in DuckDB SQL, plus
closed-form spatial predicates for the oracle.

The oracle must not reuse the library's geometry code, so shapes are carried
as (cx, cy, h, shape) and tested with half-plane signs instead of ray casting.
"""

from __future__ import annotations

_VIS = "['clear','cloudy','foggy','rainy','stormy']"
_WIND = "['calm','slight_winds','heavy_winds','dangerous_winds']"
_WAIVER = ("['operations_from_moving_vehicle','night_operations',"
           "'beyond_visual_line_of_sight','operations_over_people']")

STATUS = ("CASE o_orderstatus WHEN 'P' THEN 'proposed' WHEN 'O' THEN 'approved' "
          "ELSE 'rescinded' END")

FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _def(name: str, sql: str, deps: tuple[str, ...] = ()):
    FIXTURES[name] = (sql, deps)


_def("live_positions", """
SELECT 'r-' || CAST(event_id AS VARCHAR) AS report_id,
       'SN-' || CAST(user_id AS VARCHAR) AS drone_serial_number,
       ts AS recorded_at,
       47.0::DOUBLE + CAST(event_id % 512 AS DOUBLE) / 1024.0 AS latitude,
       -123.0::DOUBLE + CAST(event_id * 7 % 1024 AS DOUBLE) / 1024.0 AS longitude,
       value AS altitude_ft, ts AS ingested_at, event_id
FROM events""")

_def("live_stored", """
SELECT * FROM live_positions WHERE recorded_at < TIMESTAMP '2024-01-16 00:00:00'""", ("live_positions",))

_def("live_batch", """
SELECT *, 0 AS attempt FROM live_positions WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00'
UNION ALL
SELECT *, 1 AS attempt FROM live_positions WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00'""",
     ("live_positions",))

_def("sensors", """
SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS sensor_id, s_name AS name,
       CASE WHEN s_suppkey % 2 = 1 THEN 'note ' || CAST(s_suppkey AS VARCHAR) END AS notes,
       47.0::DOUBLE + CAST(s_suppkey * 37 % 512 AS DOUBLE) / 1024.0 AS latitude,
       -123.0::DOUBLE + CAST(s_suppkey * 101 % 1024 AS DOUBLE) / 1024.0 AS longitude,
       1000.0::DOUBLE + CAST(s_suppkey % 10 AS DOUBLE) * 500 AS sensing_radius_meters,
       CASE WHEN s_suppkey % 2 = 0 THEN 'online' ELSE 'offline' END AS status,
       TIMESTAMP '2023-12-01 00:00:00' + to_seconds(s_suppkey) AS created_at,
       s_suppkey
FROM supplier""")

_def("sensor_profiles", """
SELECT 'S-' || CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey + 100000 END AS VARCHAR) AS sensor_id,
       2000 + s_suppkey % 7 * 100 AS poll_min, 5000 AS poll_max,
       200 AS latency_min, 1000 + s_suppkey % 5 * 100 AS latency_max,
       'p' || CAST(s_suppkey AS VARCHAR) AS label,
       TIMESTAMP '2023-12-02 00:00:00' + to_seconds(s_suppkey) AS created_at
FROM supplier""")

_def("sensor_positions", """
SELECT 'r-' || CAST(event_id AS VARCHAR) AS report_id,
       'SN-' || CAST(user_id AS VARCHAR) AS drone_serial_number,
       'S-' || CAST(event_id % ((SELECT count(*) FROM supplier) + 5) AS VARCHAR) AS sensor_id,
       ts AS recorded_at,
       47.0::DOUBLE + CAST(event_id % 512 AS DOUBLE) / 1024.0 AS latitude,
       -123.0::DOUBLE + CAST(event_id * 7 % 1024 AS DOUBLE) / 1024.0 AS longitude,
       value AS altitude_ft, ts AS ingested_at, event_id // 50 AS batch_id, event_id
FROM events""")


def _zone_sql(layer: str) -> str:
    if layer == "visibility":
        state = f"{_VIS}[event_id % 5 + 1] AS state, CASE WHEN event_id % 5 = 2 THEN value * 10 END AS ceiling_ft,"
    else:
        state = f"{_WIND}[event_id % 4 + 1] AS state,"
    return f"""
SELECT 'z-' || CAST(event_id AS VARCHAR) AS report_id,
       'Z-' || CAST(user_id % 20 AS VARCHAR) AS zone_id,
       CASE WHEN event_type IN ('view','click','signup') THEN 'observed' ELSE 'forecast' END AS kind,
       CASE WHEN event_type IN ('view','click','signup') THEN ts ELSE date_trunc('hour', ts) END AS recorded_at,
       {state}
       -123.0::DOUBLE + CAST(event_id * 13 % 1024 AS DOUBLE) / 1024.0 AS cx,
       47.0::DOUBLE + CAST(event_id * 5 % 512 AS DOUBLE) / 1024.0 AS cy,
       CAST(8 + event_id % 25 AS DOUBLE) / 256.0 AS h,
       CASE WHEN event_id % 4 = 0 THEN 'tri' WHEN event_id % 8 = 1 THEN 'holed' ELSE 'box' END AS shape,
       CASE WHEN event_type IN ('view','click','signup') THEN ts ELSE ts - to_hours(event_id % 7) END AS ingested_at,
       event_id
FROM events"""


_def("zone_reports", _zone_sql("visibility"))
_def("wind_reports", _zone_sql("wind"))
_def("observed_reports", "SELECT * FROM zone_reports WHERE kind = 'observed'", ("zone_reports",))
_def("forecast_reports", "SELECT * FROM zone_reports WHERE kind = 'forecast'", ("zone_reports",))
_def("wind_observed", "SELECT * FROM wind_reports WHERE kind = 'observed'", ("wind_reports",))

_def("owners", """
SELECT 'O-' || CAST(c_custkey AS VARCHAR) AS owner_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'organization' ELSE 'individual' END AS owner_type,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS company_name,
       'First' || CAST(c_custkey AS VARCHAR) AS first_name, c_name AS last_name,
       '+1-555-' || CAST(c_custkey AS VARCHAR) AS phone_number,
       'Street ' || CAST(c_custkey AS VARCHAR) AS address_line1,
       CASE WHEN c_custkey % 2 = 0 THEN 'Unit ' || CAST(c_custkey AS VARCHAR) END AS address_line2,
       'City ' || CAST(c_nationkey AS VARCHAR) AS address_city, 'WA' AS address_state,
       '98' || CAST(c_custkey % 1000 AS VARCHAR) AS address_zip,
       'o' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       TIMESTAMP '2025-01-01 00:00:00' + to_seconds(c_custkey) AS created_at,
       TIMESTAMP '2025-01-01 00:00:00' + to_seconds(c_custkey) AS updated_at,
       c_custkey
FROM customer""")

_def("pilots", """
SELECT CASE WHEN c_custkey % 3 = 0 THEN 'P-' ELSE 'PX-' END || CAST(c_custkey AS VARCHAR) AS pilot_id,
       'O-' || CAST(c_custkey % 1000 AS VARCHAR) AS organization_owner_id,
       c_name AS name, '+1-555-' || CAST(c_custkey AS VARCHAR) AS phone_number,
       'LIC-' || CAST(c_custkey AS VARCHAR) AS license_number,
       TIMESTAMP '2025-02-01 00:00:00' + to_seconds(c_custkey) AS created_at, c_custkey
FROM customer""")

_def("registrations", """
SELECT 'R-' || CAST(o_orderkey AS VARCHAR) AS registration_id,
       'SN-' || CAST(o_custkey // 10 AS VARCHAR) AS serial_number,
       'Acme' AS make, 'M' || CAST(o_orderkey % 13 AS VARCHAR) AS model_number,
       'O-' || CAST(o_custkey AS VARCHAR) AS owner_id,
       DATE '2023-09-01' + CAST(o_orderkey % 180 AS INTEGER) AS start_date,
       DATE '2023-09-01' + CAST(o_orderkey % 180 AS INTEGER) + CAST(o_orderkey % 60 AS INTEGER) AS end_date,
       TIMESTAMP '2023-08-01 00:00:00' + to_seconds(o_orderkey) AS created_at,
       o_orderkey AS arrival
FROM orders""")


def _window_sql(offset: int) -> str:
    return (f"TIMESTAMP '2024-01-01 00:00:00' + to_hours(o_orderkey % 720 + {offset}) AS start_time, "
            f"TIMESTAMP '2024-01-01 00:00:00' + to_hours(o_orderkey % 720 + {offset}) "
            f"+ to_hours(1 + o_orderkey % 12) AS end_time")


_def("authorizations", f"""
SELECT 'A-' || CAST(o_orderkey AS VARCHAR) AS authorization_id,
       -123.0::DOUBLE + CAST(o_orderkey * 29 % 1024 AS DOUBLE) / 1024.0 AS cx,
       47.0::DOUBLE + CAST(o_orderkey * 11 % 512 AS DOUBLE) / 1024.0 AS cy,
       CAST(1 + o_orderkey % 8 AS DOUBLE) / 128.0 AS h,
       CASE WHEN o_orderkey % 3 = 0 THEN 'tri' ELSE 'box' END AS shape,
       CAST(o_orderkey % 2001 AS DOUBLE) AS max_altitude_ft,
       {_window_sql(0)},
       'O-' || CAST(o_custkey AS VARCHAR) AS owner_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'P-' || CAST(o_custkey - o_custkey % 3 AS VARCHAR) END AS pilot_id,
       {STATUS} AS status,
       TIMESTAMP '2023-12-01 00:00:00' + to_seconds(o_orderkey) AS created_at,
       o_orderkey
FROM orders""")

_def("flight_plans", f"""
SELECT 'FP-' || CAST(o_orderkey AS VARCHAR) AS flight_plan_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'waypoints' ELSE 'polygon' END AS plan_type,
       'O-' || CAST(o_custkey AS VARCHAR) AS owner_id,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'R-' || CAST(o_orderkey AS VARCHAR)
            WHEN 2 THEN 'R-' || CAST(o_orderkey + 1 AS VARCHAR) ELSE 'R-X' || CAST(o_orderkey AS VARCHAR) END
         AS registration_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'P-' || CAST(o_custkey - o_custkey % 3 AS VARCHAR) END AS pilot_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'A-' || CAST(o_orderkey AS VARCHAR)
            WHEN o_orderkey % 5 = 1 THEN 'A-X' || CAST(o_orderkey AS VARCHAR) END AS airspace_authorization_id,
       {_window_sql(3)},
       -123.0::DOUBLE + CAST(o_orderkey * 37 % 1024 AS DOUBLE) / 1024.0 AS cx,
       47.0::DOUBLE + CAST(o_orderkey * 3 % 512 AS DOUBLE) / 1024.0 AS cy,
       CAST(1 + o_orderkey % 4 AS DOUBLE) / 128.0 AS h,
       CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey % 2001 AS DOUBLE) END AS polygon_max_altitude_ft,
       TIMESTAMP '2023-12-01 00:00:00' + to_seconds(o_orderkey) AS created_at,
       o_orderkey
FROM orders""")

_def("lineitem_pairs", """
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS l_linenumber,
       l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
FROM lineitem""")

_def("waypoints", """
SELECT 'FP-' || CAST(l_orderkey + l_orderkey % 2 AS VARCHAR) AS flight_plan_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey + l_orderkey % 2 ORDER BY l_orderkey, l_linenumber) - 1 AS INTEGER) AS sequence_number,
       47.0::DOUBLE + CAST(l_partkey * 3 % 512 AS DOUBLE) / 1024.0 AS lat,
       -123.0::DOUBLE + CAST((l_partkey * 7 + l_linenumber * 131) % 1024 AS DOUBLE) / 1024.0 AS lon,
       l_quantity * 4 AS altitude_min_ft, l_quantity * 4 + 100 AS altitude_max_ft,
       CAST(l_linenumber * 200 AS DOUBLE) AS radius_meters
FROM lineitem_pairs""", ("lineitem_pairs",))

_def("waivers", f"""
SELECT 'WV-' || CAST(o_orderkey AS VARCHAR) AS waiver_id,
       {_WAIVER}[o_orderkey % 4 + 1] AS waiver_type,
       CASE WHEN o_orderkey % 2 = 0 THEN 'P-' || CAST(o_custkey - o_custkey % 3 AS VARCHAR) END AS pilot_id,
       CASE WHEN o_orderkey % 2 = 1 THEN 'O-' || CAST(o_custkey AS VARCHAR) END AS owner_id,
       o_orderpriority AS conditions,
       {_window_sql(6)},
       {STATUS} AS status,
       TIMESTAMP '2023-12-01 00:00:00' + to_seconds(o_orderkey) AS created_at,
       o_orderkey
FROM orders""")

_def("lifecycle_patches", """
SELECT 'A-' || CAST(l_orderkey AS VARCHAR) AS target_id, CAST(l_linenumber AS BIGINT) AS seq,
       CASE l_returnflag WHEN 'R' THEN 'rescinded' WHEN 'A' THEN 'approved' END AS status,
       CASE WHEN l_linestatus = 'O' THEN l_quantity * 10 END AS max_altitude_ft,
       l_partkey % 5 = 0 AS pilot_present,
       CASE l_partkey % 15 WHEN 5 THEN 'own' WHEN 10 THEN 'P-' || CAST(l_partkey AS VARCHAR) END AS pilot_pick,
       CASE WHEN l_partkey % 7 IN (3, 6) THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours((l_suppkey * 13 + l_linenumber * 5) % 720)
         END AS start_time,
       CASE WHEN l_partkey % 7 IN (5, 6) THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours((l_suppkey * 17 + l_linenumber * 7) % 760)
         END AS end_time
FROM lineitem_pairs""", ("lineitem_pairs",))


def with_fixtures(*names: str) -> str:
    """``WITH`` clause defining the named fixtures and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][0]})" for n in order) + "\n"


# ------------------------------------------------------------ closed-form geometry

def contains_sql(x: str, y: str, t: str) -> str:
    """Strict containment of (x, y) in the shape (cx, cy, h, shape) of alias ``t``."""
    cx, cy, h, s = f"{t}.cx", f"{t}.cy", f"{t}.h", f"{t}.shape"
    box = f"({x} > {cx} - {h} AND {x} < {cx} + {h} AND {y} > {cy} - {h} AND {y} < {cy} + {h})"
    in_hole = (f"({x} >= {cx} - {h} / 2 AND {x} <= {cx} + {h} / 2 "
               f"AND {y} >= {cy} - {h} / 2 AND {y} <= {cy} + {h} / 2)")
    # CCW triangle A(cx-h, cy-h) B(cx+h, cy-h) C(cx, cy+h): strictly left of every edge
    tri = (f"({y} > {cy} - {h} "
           f"AND (-{h}) * ({y} - ({cy} - {h})) - (2 * {h}) * ({x} - ({cx} + {h})) > 0 "
           f"AND (-{h}) * ({y} - ({cy} + {h})) + (2 * {h}) * ({x} - {cx}) > 0)")
    return (f"(CASE {s} WHEN 'tri' THEN {tri} WHEN 'holed' THEN {box} AND NOT {in_hole} "
            f"ELSE {box} END)")


def box_meets_sql(t: str, bx0: str, by0: str, bx1: str, by1: str) -> str:
    """Closed shape of alias ``t`` meets the closed box (separating axes)."""
    cx, cy, h, s = f"{t}.cx", f"{t}.cy", f"{t}.h", f"{t}.shape"
    overlap = f"({cx} - {h} <= {bx1} AND {cx} + {h} >= {bx0} AND {cy} - {h} <= {by1} AND {cy} + {h} >= {by0})"
    corners = [(bx0, by0), (bx1, by0), (bx1, by1), (bx0, by1)]

    def outside(ax, ay, ex, ey):
        # all four corners strictly right of the directed edge (a, a + e)
        return "(" + " AND ".join(f"(({ex}) * (({py}) - ({ay})) - ({ey}) * (({px}) - ({ax})) < 0)"
                                  for px, py in corners) + ")"

    ax, ay = f"{cx} - {h}", f"{cy} - {h}"
    bx, by = f"{cx} + {h}", f"{cy} - {h}"
    cxx, cyy = f"{cx}", f"{cy} + {h}"
    tri = (f"({overlap} AND NOT {outside(ax, ay, f'({bx}) - ({ax})', f'({by}) - ({ay})')} "
           f"AND NOT {outside(bx, by, f'({cxx}) - ({bx})', f'({cyy}) - ({by})')} "
           f"AND NOT {outside(cxx, cyy, f'({ax}) - ({cxx})', f'({ay}) - ({cyy})')})")
    in_hole = (f"({bx0} > {cx} - {h} / 2 AND {bx1} < {cx} + {h} / 2 "
               f"AND {by0} > {cy} - {h} / 2 AND {by1} < {cy} + {h} / 2)")
    return (f"(CASE {s} WHEN 'tri' THEN {tri} WHEN 'holed' THEN {overlap} AND NOT {in_hole} "
            f"ELSE {overlap} END)")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))")


def disc_meets_sql(w: str, b: str) -> str:
    """The disc of alias ``w`` (lat, lon, radius_meters) meets the box of alias ``b`` (bx0, by0, bx1, by1):
    straight up or down within the box's longitudes, else the nearest point of its two meridian sides."""
    la, lo = f"{w}.lat", f"{w}.lon"
    x0, y0, x1, y1 = f"{b}.bx0", f"{b}.by0", f"{b}.bx1", f"{b}.by1"
    clamp = haversine_sql(la, lo, f"least(greatest({la}, {y0}), {y1})", f"least(greatest({lo}, {x0}), {x1})")

    def foot(x):
        return (f"least(greatest(degrees(atan2(sin(radians({la})), cos(radians({la})) * cos(radians({x} - {lo})))), "
                f"{y0}), {y1})")
    side = ", ".join(haversine_sql(la, lo, y, x) for x in (x0, x1) for y in (foot(x), y0, y1))
    return (f"({w}.radius_meters > 0 AND CASE WHEN {clamp} <= {w}.radius_meters THEN true "
            f"WHEN {lo} BETWEEN {x0} AND {x1} THEN false ELSE least({side}) <= {w}.radius_meters END)")


def iso(ts: str) -> str:
    """Microsecond text of an instant, the same text Spark's ``iso_text`` gives."""
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"
