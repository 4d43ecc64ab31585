"""Planar geometry as Catalyst expressions.

Geometry convention: a polygon is ``ARRAY<ARRAY<STRUCT<lon DOUBLE, lat DOUBLE>>>``;
ring 0 is the shell, further rings are holes, each ring closed (first == last).
Everything here returns a ``Column`` built from built-in functions and
higher-order functions, so it runs inside whole-stage code generation on the
executors; there is no Python UDF.

Semantics kept from the reference's spatial SQL:

* point in polygon (``operators.covering``): strict interior. A point on any ring edge is not
  contained; points inside a hole are not contained.
* polygon meets box (``box_meets_edges_sql``): closed. Touching counts.
* ``disc_box_intersects``: a point buffered by metres meets a box; a radius
  ``<= 0`` never meets anything.

Always pair the exact tests with a bounding-box filter first: the exact tests
iterate over ring edges per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres used for great-circle distances.
EARTH_RADIUS_M = 6371008.8

# Grid: power-of-two cell sizes keep floor(x / c) exact. Each level's cells are 8 times as wide
# as those of the level below; at the top one the world is six cells.
DEFAULT_CELL_DEG = 1.0 / 16          # level 0, ~7 km x 5 km at 47N
TOP_LEVEL = 4
CELLS_PER_SIDE = 9                   # a shape goes to the lowest level where it spans no more


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def vertex(lon, lat) -> Column:
    return F.struct(_c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat"))


def box_rings(min_lon, min_lat, max_lon, max_lat) -> Column:
    """Counter-clockwise closed rectangle as a one-ring polygon."""
    x0, y0, x1, y1 = _c(min_lon), _c(min_lat), _c(max_lon), _c(max_lat)
    return F.array(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))


def ring_from_points(*pts) -> Column:
    """Closed ring from (lon, lat) pairs; the first point is repeated at the end."""
    vs = [vertex(x, y) for x, y in pts]
    return F.array(*(vs + [vs[0]]))


def bbox(rings) -> Column:
    """STRUCT(min_lon, min_lat, max_lon, max_lat) of all vertices (holes are inside the shell)."""
    shell = _c(rings)[0]
    lons = F.transform(shell, lambda v: v["lon"])
    lats = F.transform(shell, lambda v: v["lat"])
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
                    F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def normalize_box(lat1, lon1, lat2, lon2) -> Column:
    """Box from corners given in any order (LEAST/GREATEST); no antimeridian wrap."""
    return F.struct(F.least(_c(lon1), _c(lon2)).alias("min_lon"), F.least(_c(lat1), _c(lat2)).alias("min_lat"),
                    F.greatest(_c(lon1), _c(lon2)).alias("max_lon"), F.greatest(_c(lat1), _c(lat2)).alias("max_lat"))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def disc_box_intersects(lat, lon, radius_m, min_lon, min_lat, max_lon, max_lat) -> Column:
    """Disc of ``radius_m`` metres around (lat, lon) meets the closed box, exactly on the sphere.

    A centre within the box's longitudes is nearest to it along its own meridian. Any other is
    nearest to a point of one of the two sides that are meridians: the foot of the great circle at
    right angles to it, if that lies on the side, or one of the side's ends. The box point at the
    clamped coordinates is tried first: if that is near enough, the disc meets the box.
    """
    la, lo, r = _c(lat), _c(lon), _c(radius_m)
    x0, y0, x1, y1 = _c(min_lon), _c(min_lat), _c(max_lon), _c(max_lat)
    near = lo + F.lit(360.0) * F.round(((x0 + x1) / 2 - lo) / 360.0)
    clamped = haversine_m(la, near, F.least(F.greatest(la, y0), y1), F.least(F.greatest(near, x0), x1))

    def foot(x):
        """Nearest latitude of the side at longitude ``x``."""
        phi, d = F.radians(la), F.radians(x - lo)
        return F.least(F.greatest(F.degrees(F.atan2(F.sin(phi), F.cos(phi) * F.cos(d))), y0), y1)

    side = F.least(*[haversine_m(la, lo, y, x) for x in (x0, x1) for y in (foot(x), y0, y1)])
    return (r > 0) & F.when(clamped <= r, F.lit(True)).when((near >= x0) & (near <= x1), F.lit(False)).otherwise(side <= r)


def disc_sure(lat, radius_m) -> Column:
    """The square of the chord, in degrees, within which ``disc_surely_meets`` is certain; -1 near a pole, where it never is."""
    chord = F.degrees(2 * F.sin(F.least(_c(radius_m) / (2 * EARTH_RADIUS_M), F.lit(1.5)))) * (1 - 1e-9) - 1e-12
    return F.when((chord > 0) & (F.abs(_c(lat)) < 89), chord * chord).otherwise(F.lit(-1.0))


def disc_surely_meets(lat, lon, cos_lat, sure, min_lon, min_lat, max_lon, max_lat) -> Column:
    """A test without trigonometry that only holds if the disc meets the box; most pairs that meet pass it.

    Of the box point at the clamped coordinates: sin(x) <= x and cos(y) <= cos(lat) + |y - lat| bound the
    haversine from above; ``disc_sure`` leaves more than rounding can be wrong by.
    """
    zero = F.lit(0.0)
    dy = F.greatest(_c(min_lat) - _c(lat), _c(lat) - _c(max_lat), zero)
    dx = F.greatest(_c(min_lon) - _c(lon), _c(lon) - _c(max_lon), zero)
    return dy * dy + _c(cos_lat) * (_c(cos_lat) + F.radians(dy)) * dx * dx <= _c(sure)


def disc_lats(lat, radius_m) -> tuple[Column, Column]:
    """The lowest and highest latitude of the boxes of ``disc_boxes``."""
    dlat = F.degrees(_c(radius_m) / F.lit(EARTH_RADIUS_M)) * 1.01 + 1e-9
    return _c(lat) - dlat, _c(lat) + dlat


def disc_boxes(lat, lon, radius_m) -> Column:
    """Conservative lon/lat boxes around a disc, as an array: one, two where it crosses 180
    degrees, and a band around the globe where it reaches a pole. The boxes do not overlap."""
    def box(x0, y0, x1, y1):
        return F.struct(x0.alias("min_lon"), y0.alias("min_lat"), x1.alias("max_lon"), y1.alias("max_lat"))

    dlat = F.degrees(_c(radius_m) / F.lit(EARTH_RADIUS_M)) * 1.01 + 1e-9
    y0, y1 = disc_lats(lat, radius_m)
    polar = (y0 <= -89.999) | (y1 >= 89.999)
    # the widest longitude of a spherical cap, a little enlarged
    ratio = F.sin(F.radians(F.least(dlat, F.lit(90.0)))) / F.cos(F.radians(F.least(F.abs(_c(lat)), F.lit(89.9999))))
    dlon = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.01 + 1e-9
    x0, x1 = _c(lon) - dlon, _c(lon) + dlon
    west, east = F.lit(-180.000001), F.lit(180.000001)
    return (F.when(polar | (dlon >= 180), F.array(box(west, y0, east, y1)))
             .when(x0 < -180, F.array(box(west, y0, x1, y1), box(x0 + 360, y0, east, y1)))
             .when(x1 > 180, F.array(box(x0, y0, east, y1), box(west, y0, x1 - 360, y1)))
             .otherwise(F.array(box(x0, y0, x1, y1))))


def bbox_contains_strict(b: Column, lon, lat) -> Column:
    return ((_c(lon) > b["min_lon"]) & (_c(lon) < b["max_lon"])
            & (_c(lat) > b["min_lat"]) & (_c(lat) < b["max_lat"]))


def bbox_overlaps(b: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    return ((b["min_lon"] <= _c(max_lon)) & (b["max_lon"] >= _c(min_lon))
            & (b["min_lat"] <= _c(max_lat)) & (b["max_lat"] >= _c(min_lat)))


# --------------------------------------------------------------------------- grid

def own_level(b: Column, cell: float = DEFAULT_CELL_DEG) -> Column:
    """The lowest level at which a bounding box spans at most ``CELLS_PER_SIDE`` cells a side."""
    out = F.lit(TOP_LEVEL)
    for level in reversed(range(TOP_LEVEL)):
        size = cell * 8 ** level
        fits = [F.floor(b["max_" + a] / size) - F.floor(b["min_" + a] / size) < CELLS_PER_SIDE for a in ("lon", "lat")]
        out = F.when(fits[0] & fits[1], F.lit(level)).otherwise(out)
    return out


def cell_size(level: Column, cell: float = DEFAULT_CELL_DEG) -> Column:
    return F.lit(cell) * F.pow(F.lit(8.0), level)


def explode_box_cells(df, bbox_col: str, levels: Column | None = None, cell: float = DEFAULT_CELL_DEG):
    """One row per grid cell (``g_lvl, g_cx, g_cy``) of a bounding box at its own level
    (``g_own``), and at those of ``levels`` (an array) above it. At most 81 cells at its own
    level and at most 9 at each higher one. Generators, not nested higher-order functions, so
    the whole step runs as generated code."""
    b = F.col(bbox_col)
    out = df.withColumn("g_own", own_level(b, cell))
    if levels is None:
        out = out.withColumn("g_lvl", F.col("g_own"))
    else:
        out = out.withColumn("_levels", levels).withColumn("g_lvl", F.explode(F.expr(
            "concat(array(g_own), filter(_levels, x -> x > g_own))"))).drop("_levels")
    size = cell_size(F.col("g_lvl"), cell)
    out = out.withColumn("g_cx", F.explode(F.sequence(F.floor(b["min_lon"] / size).cast("long"),
                                                      F.floor(b["max_lon"] / size).cast("long"))))
    return out.withColumn("g_cy", F.explode(F.sequence(F.floor(b["min_lat"] / size).cast("long"),
                                                       F.floor(b["max_lat"] / size).cast("long"))))


def with_point_cells(df, lon: str, lat: str, levels: Column, cell: float = DEFAULT_CELL_DEG):
    """A point's cell at each of ``levels``, the levels that the shapes it is joined with use."""
    out = df.withColumn("g_lvl", F.explode(levels))
    size = cell_size(F.col("g_lvl"), cell)
    return (out.withColumn("g_cx", F.floor(F.col(lon) / size).cast("long"))
               .withColumn("g_cy", F.floor(F.col(lat) / size).cast("long")))


def levels_of(df, bbox_col: str, cell: float = DEFAULT_CELL_DEG) -> Column:
    """The levels that the boxes of ``df`` use, as an array (at most five; a scalar subquery)."""
    return df.select(F.array_sort(F.collect_set(own_level(F.col(bbox_col), cell)))).scalar()


# --------------------------------------------------------------------------- per-shape preparation

# Polygons with at most this many edges are tested by an unrolled expression (generated
# code); larger ones fall back to a higher-order-function loop (interpreted, exact too).
UNROLL_EDGES = 8


def _edge_meets_box(x1, y1, x2, y2, bx0, by0, bx1, by1) -> Column:
    ex, ey = x2 - x1, y2 - y1
    s = [ex * (cy - y1) - ey * (cx - x1) for cx, cy in ((bx0, by0), (bx1, by0), (bx1, by1), (bx0, by1))]
    all_pos = (s[0] > 0) & (s[1] > 0) & (s[2] > 0) & (s[3] > 0)
    all_neg = (s[0] < 0) & (s[1] < 0) & (s[2] < 0) & (s[3] < 0)
    overlap = ((F.least(x1, x2) <= bx1) & (F.greatest(x1, x2) >= bx0)
               & (F.least(y1, y2) <= by1) & (F.greatest(y1, y2) >= by0))
    return overlap & ~all_pos & ~all_neg


# --------------------------------------------------------------------------- SQL-text forms
# The same exact tests built as SQL text, for arguments that are column names: the JVM parses
# one string per column, instead of receiving every expression node from Python one call at a
# time (hundreds of calls for an unrolled test).

def _sql_edge(e: str, i) -> tuple[str, str, str, str]:
    return f"{e}.x1[{i}]", f"{e}.y1[{i}]", f"{e}.x2[{i}]", f"{e}.y2[{i}]"


def _sql_on_edge(x1, y1, x2, y2, x, y) -> str:
    return (f"(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x} - {x1}) = 0 AND {x} >= least({x1}, {x2}) "
            f"AND {x} <= greatest({x1}, {x2}) AND {y} >= least({y1}, {y2}) AND {y} <= greatest({y1}, {y2}))")


def _sql_crosses(x1, y1, x2, y2, x, y) -> str:
    return (f"coalesce((({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2} - {x1}) * ({y} - {y1}) "
            f"/ nullif({y2} - {y1}, 0D) + {x1}, false)")


def _sql_meets(x1, y1, x2, y2, bx0, by0, bx1, by1) -> str:
    sides = [f"(({x2} - {x1}) * ({cy} - {y1}) - ({y2} - {y1}) * ({cx} - {x1}))"
             for cx, cy in ((bx0, by0), (bx1, by0), (bx1, by1), (bx0, by1))]
    return (f"(least({x1}, {x2}) <= {bx1} AND greatest({x1}, {x2}) >= {bx0} AND least({y1}, {y2}) <= {by1} "
            f"AND greatest({y1}, {y2}) >= {by0} AND NOT ({' AND '.join(v + ' > 0' for v in sides)}) "
            f"AND NOT ({' AND '.join(v + ' < 0' for v in sides)}))")


def box_meets_edges_sql(e: str, bx0: str, by0: str, bx1: str, by1: str) -> str:
    """Closed polygon (prepared ``edges``) meets closed box: an edge meets the box (separating
    axes) or, failing that, a box corner lies inside by even-odd. Small polygons run as generated
    code; larger ones loop in one pass."""
    k, n = UNROLL_EDGES, f"size({e}.x1)"
    meets = " OR ".join(f"({i} < {n} AND {_sql_meets(*_sql_edge(e, i), bx0, by0, bx1, by1)})" for i in range(k))
    count = " + ".join(f"(CASE WHEN {i} < {n} AND {_sql_crosses(*_sql_edge(e, i), bx0, by0)} THEN 1 ELSE 0 END)"
                       for i in range(k))
    ed = _sql_edge(e, "i_")
    slow = (f"exists(sequence(0, {n} - 1), i_ -> {_sql_meets(*ed, bx0, by0, bx1, by1)}) OR "
            f"size(filter(sequence(0, {n} - 1), i_ -> {_sql_crosses(*ed, bx0, by0)})) % 2 = 1")
    return f"(CASE WHEN {n} <= {k} THEN ({meets}) OR ({count}) % 2 = 1 ELSE {slow} END)"


def ring_sql(points: list[tuple[str, str]]) -> str:
    """Closed ring as SQL text from (lon, lat) SQL expressions; the first point is repeated."""
    pts = list(points) + [points[0]]
    return "array(" + ", ".join(f"named_struct('lon', CAST({x} AS DOUBLE), 'lat', CAST({y} AS DOUBLE))"
                                for x, y in pts) + ")"


def bbox_sql(rings: str) -> str:
    """``bbox`` as SQL text (the shell holds every vertex)."""
    return (f"named_struct('min_lon', array_min(transform({rings}[0], v -> v.lon)), "
            f"'min_lat', array_min(transform({rings}[0], v -> v.lat)), "
            f"'max_lon', array_max(transform({rings}[0], v -> v.lon)), "
            f"'max_lat', array_max(transform({rings}[0], v -> v.lat)))")


def edges_sql(rings: str) -> str:
    """``edges`` as SQL text."""
    def coord(off, f):
        return f"flatten(transform({rings}, r -> transform(sequence(0, size(r) - 2), i -> r[i + {off}].{f})))"
    return (f"named_struct('x1', {coord(0, 'lon')}, 'y1', {coord(0, 'lat')}, "
            f"'x2', {coord(1, 'lon')}, 'y2', {coord(1, 'lat')})")


def is_rectangle_sql(rings: str) -> str:
    """``is_rectangle`` as SQL text."""
    return (f"(size({rings}) = 1 AND size({rings}[0]) = 5 AND forall(sequence(0, 3), "
            f"i -> {rings}[0][i].lon = {rings}[0][i + 1].lon OR {rings}[0][i].lat = {rings}[0][i + 1].lat))")
