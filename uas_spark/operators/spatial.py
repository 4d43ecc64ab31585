"""Spatial search and spatial probe joins.

No spatial join here is a cartesian product or an unchecked broadcast. Shapes
are exploded into the cells of their bounding box at the grid level where it spans at most
nine cells a side (``functions.geo.own_level``); points carry one cell for each level in use.
Windows of time have levels too: a window goes to the level where it meets at most 16 buckets.
So neither a shape as large as the world nor a window of many years makes many rows. The join
is an equi-join on the cell (plus the time bucket when a window is part of the predicate),
which Spark shuffles by key and AQE splits when a cell is hot. Exact tests run only on
candidate pairs, after a bounding-box test.

Pairs are produced once: a point lies in exactly one cell per level and a
shape uses exactly one level; a box and a shape meet at the higher of their levels, where they may share
several cells, so the pair is kept only in the cell holding the lower-left
corner of the two bounding boxes' overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage
from . import asof
from .covering import CELL_KEYS, covering, holds_point

HOUR_US = asof.HOUR_US
# Time bucket of window joins (authorizations, plans): about the typical window length, so a
# window explodes into few buckets while a probe still meets few windows per bucket.
WINDOW_BUCKET_US = 6 * HOUR_US


def _us(c):
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def guarded(cheap: Column, exact: Column) -> Column:
    """``cheap AND exact`` with the order fixed: the exact (edge-iterating) test only runs on
    rows passing the cheap one. A ``CASE WHEN`` is not split into conjuncts, so Catalyst
    cannot move the expensive test ahead of the cheap filters inside a join condition."""
    return F.when(cheap, exact).otherwise(F.lit(False))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The equi-join on cells and buckets. It is never a broadcast: both sides are exploded, by up to 81 cells
    and 16 buckets a row, which the planner's estimate of their size does not know, so a side that it
    takes to be small could be more than the driver can hold."""
    return left.join(right.hint("merge"), keys, "inner")


# ------------------------------------------------------------------ grid and time levels

TIME_TOP, BUCKETS = 7, 16  # a window goes to the lowest time level where it meets at most 16 buckets


def _time_level(from_us: Column, to_us: Column, bucket_us: int) -> Column:
    out = F.lit(TIME_TOP)
    for level in reversed(range(TIME_TOP)):
        size = float(bucket_us * 8 ** level)
        out = F.when(F.floor(to_us / size) - F.floor(from_us / size) < BUCKETS, F.lit(level)).otherwise(out)
    return out


def _bucket_size(bucket_us: int) -> Column:
    return F.lit(float(bucket_us)) * F.pow(F.lit(8.0), F.col("g_tl"))


def with_windows(df: DataFrame, from_us: Column, to_us: Column, bucket_us: int,
                  source: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Explode windows into the buckets of their time level (``g_tl, g_tb``; at most 16 rows,
    however long the window), and the array of the levels in use. They are found by a scalar
    subquery, on ``source`` if given: a cheaper table with all windows of ``df``."""
    leveled = df.withColumn("g_tl", _time_level(from_us, to_us, bucket_us))
    levels = (df if source is None else source).select(
        F.array_sort(F.collect_set(_time_level(from_us, to_us, bucket_us)))).scalar()
    size = _bucket_size(bucket_us)
    return leveled.withColumn("g_tb", F.explode(F.sequence(F.floor(from_us / size).cast("long"),
                                                           F.floor(to_us / size).cast("long")))), levels


def with_instants(df: DataFrame, at_us: Column, levels: Column, bucket_us: int) -> DataFrame:
    """The bucket of an instant at each time level in use."""
    out = df.withColumn("g_tl", F.explode(levels))
    return out.withColumn("g_tb", F.floor(at_us / _bucket_size(bucket_us)).cast("long"))


_SIDES = ("min_lon", "min_lat", "max_lon", "max_lat")


def _flat(box: str, prefix: str) -> list[Column]:
    """A box's sides as plain columns: a join's condition reads them for every candidate."""
    return [F.col(f"{box}.{side}").alias(prefix + side) for side in _SIDES]


def _placed(df: DataFrame, box: str, prefix: str, levels: Column, cell: float) -> DataFrame:
    """``df`` in the cells of its boxes, the box's sides flat, and whether the cell is of the box's own level
    and in its first column and row."""
    out = geo.explode_box_cells(df, box, levels, cell)
    size = geo.cell_size(F.col("g_lvl"), cell)
    return out.select(*[c for c in out.columns if c != "g_own"], *_flat(box, prefix),
                      (F.col("g_lvl") == F.col("g_own")).alias(prefix + "own"),
                      (F.floor(F.col(f"{box}.min_lon") / size) == F.col("g_cx")).alias(prefix + "west"),
                      (F.floor(F.col(f"{box}.min_lat") / size) == F.col("g_cy")).alias(prefix + "south"))


_MARKS = [prefix + name for prefix in ("_b_", "_s_") for name in (*_SIDES, "own", "west", "south")]


def _meeting_cells(boxes: DataFrame, bbox_col: str, shapes: DataFrame, cell: float,
                   source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides' cells. A pair meets at the higher of its two own levels (``_boxes_meet``):
    each side goes to its own level and to the higher ones that the other side uses, so a box as
    large as the world costs a few rows, not millions. ``source``: a cheaper table with all boxes
    of ``shapes``."""
    b = _placed(boxes, bbox_col, "_b_", geo.levels_of(shapes if source is None else source, "_sb", cell), cell)
    s = _placed(shapes, "_sb", "_s_", geo.levels_of(boxes, bbox_col, cell), cell).drop("_sb")
    return b, s


def _boxes_meet(low: Column | None = None, high: Column | None = None) -> Column:
    """The boxes overlap, at their common level, and in the one shared cell that holds the lower-left corner
    of the overlap: the later of the two first columns, and rows, is the cell's own. ``low``, ``high``: the
    latitudes of the shape's box, if it does not carry them."""
    c = F.col
    low, high = (c("_s_min_lat"), c("_s_max_lat")) if low is None else (low, high)
    return ((c("_b_own") | c("_s_own")) & (c("_b_west") | c("_s_west")) & (c("_b_south") | c("_s_south"))
            & (c("_s_min_lon") <= c("_b_max_lon")) & (c("_s_max_lon") >= c("_b_min_lon"))
            & (low <= c("_b_max_lat")) & (high >= c("_b_min_lat")))


def _light(shapes: DataFrame, rings_col: str) -> DataFrame:
    """Shapes without their rings but with a bounding box ``_sb``: what the grid join shuffles."""
    return shapes.withColumn("_sb", F.expr(geo.bbox_sql(f"`{rings_col}`"))).drop(rings_col)


def _rings_back(cand: DataFrame, shapes: DataFrame, key: list[str], rings_col: str) -> DataFrame:
    """Join the exact-test data of each shape to the candidate pairs by the shape's full key.

    The shapes side is prepared once per shape (flat edge arrays), so the per-pair test loops over
    primitive arrays, and rectangles skip it: their bounding-box test, already applied, is exact.
    One shuffle of the few candidates and of each shape once, instead of shuffling rings with
    every exploded cell and bucket.
    """
    r = f"`{rings_col}`"
    prep = shapes.select(*key, F.expr(geo.edges_sql(r)).alias("_edges"), F.expr(geo.is_rectangle_sql(r)).alias("_rect"))
    return cand.join(prep, key, "inner")


def _exact_box(b: str) -> Column:
    return F.expr(geo.box_meets_edges_sql("_edges", *(b + side for side in _SIDES)))


# ------------------------------------------------------------------ points in polygons

def _levels(cov: DataFrame) -> Column:
    """The grid levels that a (saved) covering uses, as an array."""
    return cov.select(F.array_sort(F.collect_set("g_lvl"))).scalar()


def _holding(points: DataFrame, covered: DataFrame, keys: list[str], cov: DataFrame, lon: str, lat: str,
             cheap: Column | None = None) -> DataFrame:
    """Points joined with the rows of ``covered`` that hold them (and pass ``cheap``). Cells with edges, if the
    (saved) covering ``cov`` has any, are joined apart: rectangles and inside cells, most of what is found, then
    need a test so short that the join runs as generated code."""
    crossed = F.coalesce(F.size("_edges.x1") > 0, F.lit(False))

    def held(some: DataFrame, edges: bool) -> DataFrame:
        test = holds_point(lon, lat, edges)
        return grid_join(points, some, keys).filter(test if cheap is None else guarded(cheap, test))

    plain = held(covered.filter(~crossed), False)
    return plain if cov.filter(crossed).isEmpty() else plain.unionByName(held(covered.filter(crossed), True))


def points_in_shapes(points: DataFrame, shapes: DataFrame, rings_col: str, key: list[str], lon: str = "lon",
                     lat: str = "lat", cell: float = geo.DEFAULT_CELL_DEG) -> DataFrame:
    """All (point, shape) pairs with the point strictly inside the shape, without the rings; ``key``
    identifies a shape.

    Points meet the cells of the shapes' coverings: a cell carries the edges that cross it, no
    more, and a point in an inside cell is not tested. Column names must be disjoint.
    """
    cov = cut_lineage(covering(shapes, key, rings_col, cell))
    p = geo.with_point_cells(points, lon, lat, _levels(cov), cell)
    return _holding(p, cov, CELL_KEYS, cov, lon, lat).drop(*_COVER).join(shapes.drop(rings_col), key)


def _covered(light: DataFrame, cov: DataFrame, key: list[str]) -> DataFrame:
    """``light`` (shapes without rings) with a row per cell of its covering. The cell's edges come along:
    candidates are tested where they meet, and only pairs that hold leave the join."""
    return light.join(cov, key)


_COVER = [*CELL_KEYS, "_sb", "_rect", "_edges", "_odd", "_size"]


CARRIED = 16  # points of the rings that a shape carries through the grid join


def boxes_meet_shapes(boxes: DataFrame, shapes: DataFrame, rings_col: str, key: list[str], bbox_col: str = "box",
                      cell: float = geo.DEFAULT_CELL_DEG, window: tuple[str, str, str] | None = None,
                      cheap: Column | None = None, bucket_us: int = WINDOW_BUCKET_US,
                      rings_source: DataFrame | None = None) -> DataFrame:
    """All (box, shape) pairs whose closed regions meet. ``bbox_col`` is a normalised box struct;
    ``key`` identifies a shape (its rings join back only for candidate pairs, from
    ``rings_source`` if given).

    ``window`` = (shape_from, shape_to, box_at) adds the closed time test and puts the time
    bucket into the join key; ``cheap`` is an extra filter evaluated before the exact test.
    """
    keys = list(CELL_KEYS)
    test = _boxes_meet()
    if window is not None:
        f, t, at = window
        keys += ["g_tl", "g_tb"]
        test = test & (F.col(f) <= F.col(at)) & (F.col(t) >= F.col(at))
    if cheap is not None:
        test = test & cheap
    light = _light(shapes if window is None else shapes.filter(F.col(f) <= F.col(t)), rings_col)

    def met(s: DataFrame, test: Column) -> DataFrame:
        b, s = _meeting_cells(boxes, bbox_col, s, cell, light)
        if window is not None:
            s, levels = with_windows(s, _us(f), _us(t), bucket_us, light)
            b = with_instants(b, _us(at), levels, bucket_us)
        return grid_join(b, s, keys).filter(test).drop(*keys, *_MARKS)

    exact = F.col("_rect") | _exact_box(f"`{bbox_col}`.")
    if rings_source is not None:
        return _rings_back(met(light, test), rings_source, key, rings_col).filter(exact).drop("_edges", "_rect")
    # rectangles need no more than the test of boxes; other shapes of few edges carry them through the grid
    # and are tested where pairs meet, so no candidate is shuffled; the rings of others join back for
    # their candidates
    r = f"`{rings_col}`"
    few = F.expr(f"aggregate({r}, 0, (n, x) -> n + size(x)) <= {CARRIED} AND forall({r}, x -> size(x) > 1)")
    carried = _rings_back(light, shapes.filter(few), key, rings_col)
    plain = met(carried.filter("_rect").drop("_edges", "_rect"), test)
    near = met(carried.filter("NOT _rect").drop("_rect"), guarded(test, _exact_box("_b_"))).drop("_edges")
    many = shapes.filter(~few)
    cand = met(light.join(many.select(*key), key, "left_semi"), test)
    far = _rings_back(cand, many, key, rings_col).filter(exact).drop("_edges", "_rect")
    return plain.unionByName(near).unionByName(far)


# ------------------------------------------------------------------ weather

def _zone_cols(zones: DataFrame, prefix: str = "z_") -> DataFrame:
    return zones.select(*[F.col(c).alias(prefix + c) for c in zones.columns])


def zone_observed_at_point(observed: DataFrame, probes: DataFrame, stamp: str | None = None,
                           at: str | None = None, stale_minutes: int = 30) -> DataFrame:
    """Zones whose latest (``stamp`` given, fresh only) or as-of ``at`` report contains each probe point.

    The report is chosen per zone first, then tested against the point. Probes: probe_id, lat, lon.
    """
    pick = asof.zone_asof(observed, at) if at is not None else asof.zone_latest_fresh(observed, stamp, stale_minutes)
    return points_in_shapes(probes, _zone_cols(pick), "z_rings", ["z_recorded_at", "z_report_id"])


def zone_forecast_at_point(forecast: DataFrame, probes: DataFrame, at: str) -> DataFrame:
    """Nearest forecast per zone (T4), then point containment."""
    return points_in_shapes(probes, _zone_cols(asof.zone_forecast_nearest(forecast, at)), "z_rings",
                            ["z_recorded_at", "z_report_id"])


def zone_observed_in_extent(observed: DataFrame, boxes: DataFrame, stamp: str | None = None,
                            at: str | None = None, stale_minutes: int = 30) -> DataFrame:
    """X11 (observed): zones whose chosen report meets each box (box: normalised struct column ``box``)."""
    pick = asof.zone_asof(observed, at) if at is not None else asof.zone_latest_fresh(observed, stamp, stale_minutes)
    return boxes_meet_shapes(boxes, _zone_cols(pick), "z_rings", ["z_recorded_at", "z_report_id"],
                             rings_source=_zone_cols(observed))


def zone_forecast_in_extent(forecast: DataFrame, boxes: DataFrame, at: str) -> DataFrame:
    """X11 (forecast)."""
    return boxes_meet_shapes(boxes, _zone_cols(asof.zone_forecast_nearest(forecast, at)), "z_rings",
                             ["z_recorded_at", "z_report_id"], rings_source=_zone_cols(forecast))


# ------------------------------------------------------------------ authorizations

def covering_authorizations(auths: DataFrame, probes: DataFrame, at_col: str = "at", alt_col: str | None = None,
                            status: str | None = None, lon: str = "lon", lat: str = "lat",
                            bucket_us: int = WINDOW_BUCKET_US, cell: float = geo.DEFAULT_CELL_DEG) -> DataFrame:
    """Per probe point and instant, authorizations whose area strictly contains the point,
    whose window holds the instant (closed), with ``max_altitude_ft >= altitude`` when an altitude
    column is given and the status when given.

    Authorizations are exploded by grid cell and by time bucket of their window; probes
    carry their cell and bucket at the levels in use, so the join key includes time.
    """
    a = auths if status is None else auths.filter(F.col("status") == status)
    a = a.select(*[F.col(c).alias("a_" + c) for c in a.columns]).filter("a_start_time <= a_end_time")
    # windows that hold no instant of any probe go before they are covered
    span = probes.select(F.struct(F.min(at_col).alias("t0"), F.max(at_col).alias("t1"))).scalar()
    a = a.filter((F.col("a_end_time") >= span["t0"]) & (F.col("a_start_time") <= span["t1"]))
    key = ["a_authorization_id"]
    cov = cut_lineage(covering(a, key, "a_area", cell))
    light = a.drop("a_area")
    p = geo.with_point_cells(probes, lon, lat, _levels(cov), cell)
    la, levels = with_windows(_covered(light, cov, key), _us("a_start_time"), _us("a_end_time"), bucket_us, light)
    p = with_instants(p, _us(at_col), levels, bucket_us)
    cond = (F.col("a_start_time") <= F.col(at_col)) & (F.col("a_end_time") >= F.col(at_col))
    if alt_col is not None:
        cond = cond & (F.col("a_max_altitude_ft") >= F.col(alt_col))
    return _holding(p, la, CELL_KEYS + ["g_tl", "g_tb"], cov, lon, lat, cond).drop("g_tl", "g_tb", *_COVER)


def intersecting_authorizations(auths: DataFrame, boxes: DataFrame, alt_col: str | None = None,
                                at_col: str | None = None, status: str | None = None) -> DataFrame:
    """Authorizations whose area meets each box; optional altitude, instant and status.

    Unlike X3 there is no default instant: without ``at_col`` time is not filtered.
    """
    a = auths if status is None else auths.filter(F.col("status") == status)
    a = a.select(*[F.col(c).alias("a_" + c) for c in a.columns])
    cheap = (F.col("a_max_altitude_ft") >= F.col(alt_col)) if alt_col is not None else None
    window = ("a_start_time", "a_end_time", at_col) if at_col is not None else None
    return boxes_meet_shapes(boxes, a, "a_area", ["a_authorization_id"], window=window, cheap=cheap)


# ------------------------------------------------------------------ flight plans

DISC_CELL_DEG = geo.DEFAULT_CELL_DEG / 2  # discs of waypoints are small and many


def intersecting_flight_plans(plans: DataFrame, waypoints: DataFrame, boxes: DataFrame,
                              alt_col: str | None = None, at_col: str | None = None,
                              cell: float = geo.DEFAULT_CELL_DEG, bucket_us: int = WINDOW_BUCKET_US,
                              disc_cell: float = DISC_CELL_DEG, disc_bucket_us: int = WINDOW_BUCKET_US * 2) -> DataFrame:
    """Per box, polygon plans meeting the box (ceiling ``>=`` altitude) union waypoint plans
    with one waypoint whose disc meets the box and whose band ``(min, max]`` holds the altitude.

    Boxes need ``box_id`` and a normalised ``box`` struct. Returns (box columns...,
    flight_plan_id, plan_type, created_at), one row per (box, plan).
    """
    pl = plans.select(*[F.col(c).alias("f_" + c) for c in plans.columns])
    window = ("f_start_time", "f_end_time", at_col) if at_col is not None else None

    poly_cheap = (F.col("f_polygon_max_altitude_ft") >= F.col(alt_col)) if alt_col is not None else None
    poly = boxes_meet_shapes(boxes, pl.filter(F.col("f_plan_type") == "polygon"), "f_polygon_area",
                             ["f_flight_plan_id"], window=window, cheap=poly_cheap, cell=cell, bucket_us=bucket_us)

    # waypoint branch: each disc carries its plan's window; discs are shapes with a padded box
    w = waypoints.select(F.col("flight_plan_id").alias("w_plan"), F.col("lat").alias("w_lat"),
                         F.col("lon").alias("w_lon"), F.col("radius_meters").alias("w_r"),
                         F.col("altitude_min_ft").alias("w_min"), F.col("altitude_max_ft").alias("w_max"))
    wp_plans = pl.filter(F.col("f_plan_type") == "waypoints").select(
        "f_flight_plan_id", "f_plan_type", "f_created_at", "f_start_time", "f_end_time")
    # saved once: its levels, and the boxes', are read before the join is planned
    w = cut_lineage(_with_rivals(w, wp_plans, boxes).join(wp_plans, F.col("w_plan") == F.col("f_flight_plan_id"), "inner"))
    again = cut_lineage(boxes.groupBy("box_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("box_id"))
    if alt_col is not None:  # boxes above or below all bands
        band = w.select(F.struct(F.min("w_min").alias("lo"), F.max("w_max").alias("hi"))).scalar()
        near = boxes.filter((F.col(alt_col) > band["lo"]) & (F.col(alt_col) <= band["hi"]))
    else:
        near = boxes
    keep = [*boxes.columns, F.col("f_flight_plan_id").alias("flight_plan_id"),
            F.col("f_plan_type").alias("plan_type"), F.col("f_created_at").alias("created_at")]

    def hits(some: DataFrame, w: DataFrame) -> DataFrame:
        # all waypoint plans have the same type, and the plan's id stands once: a row goes to several cells and buckets
        # and what is told from a disc's radius or latitude is computed where pairs meet
        b, w = _meeting_cells(some, "box", w.drop("w_plan", "f_plan_type", "_listed"), disc_cell)
        w = w.drop("_s_min_lat", "_s_max_lat")
        keys = list(CELL_KEYS)
        cheap = _boxes_meet(*geo.disc_lats(F.col("w_lat"), F.col("w_r")))
        if window is not None:
            w, levels = with_windows(w.filter("f_start_time <= f_end_time"), _us("f_start_time"), _us("f_end_time"),
                                     disc_bucket_us, wp_plans)
            b = with_instants(b, _us(at_col), levels, disc_bucket_us)
            keys += ["g_tl", "g_tb"]
            cheap = cheap & (F.col("f_start_time") <= F.col(at_col)) & (F.col("f_end_time") >= F.col(at_col))
        if alt_col is not None:
            cheap = cheap & (F.col(alt_col) > F.col("w_min")) & (F.col(alt_col) <= F.col("w_max"))
        side = [F.col("_b_" + x) for x in _SIDES]

        def meets(e: Column) -> Column:
            there = geo.bbox_overlaps(e["_sb"], *side)
            if alt_col is not None:
                there = there & (F.col(alt_col) > e["w_min"]) & (F.col(alt_col) <= e["w_max"])
            return F.coalesce(guarded(there, geo.disc_box_intersects(e["w_lat"], e["w_lon"], e["w_r"], *side)), F.lit(False))

        exact = (F.when(geo.disc_surely_meets(F.col("w_lat"), F.col("w_lon"), F.cos(F.radians("w_lat")), geo.disc_sure("w_lat", "w_r"), *side), F.lit(True))
                  .otherwise(geo.disc_box_intersects(F.col("w_lat"), F.col("w_lon"), F.col("w_r"), *side)))
        # EXISTS: only the first of a plan's discs that meets the box counts
        first = (F.size("_rivals") == 0) | ~F.exists("_rivals", meets)
        met = grid_join(b, w, keys).filter(guarded(guarded(cheap, exact), first))
        return met.withColumn("f_plan_type", F.lit("waypoints")).select(*keep)

    # plans without a list of rivals, and boxes that share an id, are compared afterwards: one row per (box, plan)
    apart = near if again.isEmpty() else near.join(again, near["box_id"].eqNullSafe(again["box_id"]), "left_anti")
    wp = hits(apart, w.filter("_listed"))
    rest = [] if again.isEmpty() else [hits(near.join(again, near["box_id"].eqNullSafe(again["box_id"]), "left_semi"), w)]
    if not w.filter("NOT _listed").isEmpty():
        rest.append(hits(apart, w.filter("NOT _listed")))
    for more in rest:
        wp = wp.unionByName(more.dropDuplicates(["box_id", "flight_plan_id"]))
    return poly.select(*keep).unionByName(wp)


def _with_rivals(w: DataFrame, plans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Discs with their boxes ``_sb`` and with
    ``_rivals``, the discs of their plan that come before them and may meet a box with them: no box is wider
    or higher than the gap between them. Plans of more than ``CARRIED`` discs, or with several rows,
    have no such list (``_listed`` is false)."""
    widest = boxes.select(F.struct(F.max(F.expr("box.max_lon - box.min_lon")).alias("x"),
                                   F.max(F.expr("box.max_lat - box.min_lat")).alias("y"))).scalar()
    boxed = F.explode(geo.disc_boxes(F.col("w_lat"), F.col("w_lon"), F.col("w_r")))
    discs = w.withColumn("_sb", boxed)
    n = discs.groupBy("w_plan").agg(F.count(F.lit(1)).alias("_n"))
    once = plans.groupBy(F.col("f_flight_plan_id").alias("w_plan")).agg(F.count(F.lit(1)).alias("_p"))
    n = n.join(once, "w_plan").withColumn("_listed", (F.col("_n") <= CARRIED) & (F.col("_p") == 1)).drop("_n", "_p")
    sized = w.join(n, "w_plan").withColumn("_sb", boxed)
    lists = sized.filter("_listed").groupBy("w_plan", "_listed").agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in discs.columns if c != "w_plan"]))).alias("_all"))
    d = lists.withColumn("_reach", widest).select("w_plan", "_listed", "_all", "_reach", F.posexplode("_all").alias("_i", "_d"))
    rivals = F.expr("""filter(_all, (e, k) -> k < _i
        AND e._sb.min_lon - _d._sb.max_lon <= _reach.x + 1e-9 AND _d._sb.min_lon - e._sb.max_lon <= _reach.x + 1e-9
        AND e._sb.min_lat - _d._sb.max_lat <= _reach.y + 1e-9 AND _d._sb.min_lat - e._sb.max_lat <= _reach.y + 1e-9)""")
    d = d.select("w_plan", "_listed", "_d.*", rivals.alias("_rivals"))
    alone = sized.filter("NOT _listed").withColumn("_rivals", F.array().cast(d.schema["_rivals"].dataType))
    return d.unionByName(alone)


# ------------------------------------------------------------------ sensors

SENSOR_CELL_DEG = geo.DEFAULT_CELL_DEG / 4


def sensor_coverage(sensors: DataFrame, positions: DataFrame, cell: float = SENSOR_CELL_DEG) -> DataFrame:
    """(sensor, position report) pairs with the drone within the sensor's radius (great circle).

    There are far fewer sensors than reports, so their cells are small. A cell whose farthest point is
    within the radius (triangle inequality, from its middle) needs no distance.
    """
    s = sensors.filter("sensing_radius_meters > 0").select(*[F.col(c).alias("s_" + c) for c in sensors.columns])
    s = s.withColumn("_sb", F.explode(geo.disc_boxes(F.col("s_latitude"), F.col("s_longitude"),
                                                     F.col("s_sensing_radius_meters"))))
    p = geo.with_point_cells(positions, "longitude", "latitude", geo.levels_of(s, "_sb", cell), cell)
    size = geo.cell_size(F.col("g_lvl"), cell)
    mid_lat, mid_lon = (F.col("g_cy") + 0.5) * size, (F.col("g_cx") + 0.5) * size
    # half a cell up and half a cell sideways is the longest way from the middle, at most these metres
    reach = F.radians(size) * geo.EARTH_RADIUS_M
    held = geo.haversine_m(F.col("s_latitude"), F.col("s_longitude"), mid_lat, mid_lon) + reach <= F.col("s_sensing_radius_meters")
    s = geo.explode_box_cells(s, "_sb", None, cell).withColumn("_held", held)
    j = grid_join(p, s, CELL_KEYS)
    d = geo.haversine_m(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude"))
    return (j.filter(F.col("_held") | guarded(geo.bbox_contains_strict(F.col("_sb"), F.col("longitude"), F.col("latitude")),
                                              d <= F.col("s_sensing_radius_meters")))
             .withColumn("distance_m", d)
             .drop(*CELL_KEYS, "g_own", "_sb", "_held"))


# ------------------------------------------------------------------ positions against zones

def _interval_join(positions: DataFrame, intervals: DataFrame, cov: DataFrame, from_col: str, to_col: str,
                   bucket_us: int, cell: float, cheap: Column) -> DataFrame:
    """Grid-cell x time-bucket equi-join of positions with zone validity intervals, whose shapes
    ``cov`` covers. An interval is cut to the stretch of time that the positions span, one without any
    of it goes; an open end is that stretch's. Buckets are at most ``bucket_us`` wide, and no wider than
    a tenth of the intervals, so that most go to one bucket or two and a bucket holds a few intervals of a zone however often it reports."""
    span = positions.select(F.struct(F.min(_us("recorded_at")).alias("t0"), F.max(_us("recorded_at")).alias("t1"))).scalar()
    t_min, t_max = span["t0"], span["t1"]
    z = intervals.withColumn("_lo", F.greatest(F.coalesce(F.col(from_col), t_min), t_min))
    z = cut_lineage(z.withColumn("_hi", F.least(F.coalesce(F.col(to_col), t_max), t_max)).filter("_lo <= _hi"))
    p = geo.with_point_cells(positions, "longitude", "latitude", _levels(cov), cell)
    usual = z.select(F.percentile_approx(F.col("_hi") - F.col("_lo"), 0.9)).first()[0]
    bucket_us = min(bucket_us, max(usual or 0, MIN_BUCKET_US))
    z, levels = with_windows(_covered(z, cov, _ZONE_KEY), F.col("_lo"), F.col("_hi"), bucket_us, z)
    p = with_instants(p.withColumn("_pt", _us("recorded_at")), F.col("_pt"), levels, bucket_us)
    j = _holding(p, z, CELL_KEYS + ["g_tl", "g_tb"], cov, "longitude", "latitude", cheap)
    return j.drop("_pt", "g_tl", "g_tb", "_lo", "_hi", *_COVER)


MIN_BUCKET_US = 1_000_000
_ZONE_KEY = ["z_recorded_at", "z_report_id"]


def _zone_covering(reports: DataFrame, cell: float) -> DataFrame:
    """The coverings of all reports' polygons."""
    return cut_lineage(covering(reports.select(F.col("recorded_at").alias("z_recorded_at"),
                                               F.col("report_id").alias("z_report_id"), "rings"), _ZONE_KEY, "rings", cell))


def join_positions_zone_current(positions: DataFrame, observed: DataFrame, bucket_us: int = HOUR_US,
                                cell: float = geo.DEFAULT_CELL_DEG, interval_bucket_us: int = asof.HOUR_US) -> DataFrame:
    """For every position report, the zones whose as-of report (at the report's instant)
    contains the drone.

    Each zone report becomes a validity interval [its instant, the zone's next instant);
    exactly one interval per zone holds any instant, so "as-of first, polygon after" equals
    "interval and polygon together".
    """
    cov = _zone_covering(observed, cell)
    iv = asof.observed_intervals(observed.drop("rings"), interval_bucket_us)
    iv = iv.select(*[F.col(c).alias("z_" + c) for c in observed.columns if c != "rings"],
                   F.col("valid_from_us").alias("z_t_us"), F.col("valid_to_us").alias("z_to_us"))
    cheap = ((F.col("_pt") >= F.col("z_t_us"))
             & (F.col("z_to_us").isNull() | (F.col("_pt") < F.col("z_to_us"))))
    j = _interval_join(positions, iv, cov, "z_t_us", "z_to_us", bucket_us, cell, cheap)
    return j.drop("z_t_us", "z_to_us")


def join_positions_forecast_zone(positions: DataFrame, forecast: DataFrame, bucket_us: int = HOUR_US,
                                 cell: float = geo.DEFAULT_CELL_DEG, interval_bucket_us: int = asof.HOUR_US) -> DataFrame:
    """For every position report, zones whose nearest forecast (T4 rule) contains the drone.

    Forecast intervals are cut at midpoints between a zone's neighbouring target instants;
    a probe exactly on a midpoint goes to the side that wins T4's tie rule.
    """
    cov = _zone_covering(forecast, cell)
    iv = asof.forecast_intervals(forecast.drop("rings"), interval_bucket_us)
    iv = iv.select(*[F.col(c).alias("z_" + c) for c in forecast.columns if c != "rings"],
                   F.unix_micros(F.col("recorded_at")).alias("z_t_us"),
                   F.col("valid_from_us").alias("z_from_us"), F.col("valid_to_us").alias("z_to_us"),
                   "lo2", "hi2", "lo_in", "hi_in")
    cheap = asof.in_forecast_interval(F.col("_pt"))
    j = _interval_join(positions, iv, cov, "z_from_us", "z_to_us", bucket_us, cell, cheap)
    return j.drop("z_t_us", "z_from_us", "z_to_us", "lo2", "hi2", "lo_in", "hi_in")
