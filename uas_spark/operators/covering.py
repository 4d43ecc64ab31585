"""Polygon coverings: which grid cells a polygon holds whole, and which edges cross the others.

A polygon is covered by the cells of its own grid level (at most 81), one of more than ``FINE_EDGES`` edges
by those of the level below (at most 5,329), so that its boundary cells hold few edges. A cell without an edge lies
wholly inside or outside: inside cells need no test of their points, outside cells have no row. A
boundary cell holds the edges that meet it and whether its lower-left corner is inside. A point p
of that cell is reached from the corner c by going up to its height and then right; each step
stays in the cell, so only the cell's own edges can be crossed, and their number tells whether
p is inside. Rectangles need no covering: their bounding box is the exact test.

Edges are dealt to cells as rows and gathered per (shape, cell); no ring is ever tested as a whole.
Ties are settled as by the even-odd rule with a ray to the right (``geo._crosses``): a point stands
for one a little to the right of it and, much less, above it. The side of an edge on which the
point (c.x, p.y) lies is decided once, by the sign of one cross product, for both steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

CELL_KEYS = ["g_lvl", "g_cx", "g_cy"]
UNROLL = 4  # cells with more edges are tested in a loop
FINE_EDGES = 512


def _span(lo: Column, hi: Column) -> Column:
    """lo..hi as longs; empty where hi is smaller."""
    lo, hi = lo.cast("long"), hi.cast("long")
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<bigint>"))


def covering(shapes: DataFrame, key: list[str], rings_col: str, cell: float = geo.DEFAULT_CELL_DEG) -> DataFrame:
    """One row per shape and cell that meets its inside: key, ``g_lvl, g_cx, g_cy``, the bounding box
    ``_sb`` and ``_rect`` of rectangles, and for others the cell's ``_edges`` (struct of arrays
    x1, y1, x2, y2; empty in an inside cell) with ``_odd``, whether the corner is inside, and the cell's ``_size``."""
    r = f"`{rings_col}`"
    prep = shapes.select(*key, F.expr(geo.bbox_sql(r)).alias("_sb"), F.expr(geo.is_rectangle_sql(r)).alias("_rect"),
                         F.expr(geo.edges_sql(r)).alias("_e"))
    rect = geo.explode_box_cells(prep.filter("_rect").drop("_e"), "_sb", None, cell).drop("g_own")
    other = prep.filter("NOT _rect").withColumn(
        "g_lvl", geo.own_level(F.col("_sb"), cell) - F.when(F.size("_e.x1") > FINE_EDGES, 1).otherwise(0))
    e = other.select(*key, "g_lvl", geo.cell_size(F.col("g_lvl"), cell).alias("_size"),
                     F.col("_sb.min_lon").alias("_west"),
                     F.explode(F.arrays_zip("_e.x1", "_e.y1", "_e.x2", "_e.y2")).alias("e"))
    e = e.select("*", "e.*")
    x1, y1, x2, y2, size = (F.col(c) for c in ("x1", "y1", "x2", "y2", "_size"))
    # edges that meet a cell: by bounding box, then by the side of the edge on which the corners lie
    met = e.withColumn("g_cx", F.explode(_span(F.floor(F.least(x1, x2) / size), F.floor(F.greatest(x1, x2) / size))))
    met = met.withColumn("g_cy", F.explode(_span(F.floor(F.least(y1, y2) / size), F.floor(F.greatest(y1, y2) / size))))
    cx, cy = F.col("g_cx") * size, F.col("g_cy") * size
    met = met.filter(geo._edge_meets_box(x1, y1, x2, y2, cx, cy, cx + size, cy + size))
    # corners that have an edge to their right at their own height
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    right = e.withColumn("g_cy", F.explode(_span(F.ceil(low / size), F.ceil(high / size) - 1)))
    yl = F.col("g_cy") * size
    right = right.filter((y1 > yl) != (y2 > yl))
    right = right.withColumn("g_cx", F.explode(_span(F.floor(F.col("_west") / size), F.floor(F.greatest(x1, x2) / size))))
    xl = F.col("g_cx") * size
    side = (x2 - x1) * (yl - y1) - (y2 - y1) * (xl - x1)
    right = right.filter((side != 0) & ((side > 0) == (y2 > y1)))
    keys = [*key, *CELL_KEYS]
    both = (met.select(*keys, "e", F.lit(0).alias("_n"))
            .unionByName(right.select(*keys, F.lit(1).alias("_n")), allowMissingColumns=True))
    cells = both.groupBy(*keys).agg(F.collect_list("e").alias("_l"), (F.sum("_n") % 2 == 1).alias("_odd"))
    cells = cells.filter((F.size("_l") > 0) | F.col("_odd"))
    edges = F.expr("struct(" + ", ".join(f"transform(_l, v -> v.{c}) AS {c}" for c in ("x1", "y1", "x2", "y2")) + ")")
    size = geo.cell_size(F.col("g_lvl"), cell).alias("_size")
    return (cells.select(*keys, F.lit(False).alias("_rect"), edges.alias("_edges"), "_odd", size)
            .unionByName(rect.select(*keys, "_sb", "_rect"), allowMissingColumns=True))


def _crossings(e: str, i: str | int, x: str, y: str, x0: str, y0: str) -> tuple[str, str]:
    """(whether the point is on edge ``i``, times that the way from the corner crosses it), as SQL."""
    x1, y1, x2, y2 = geo._sql_edge(e, i)

    def passed(at: str) -> str:
        """The edge meets the line x = x0 no higher than ``at``."""
        s = f"(({x2} - {x1}) * ({at} - {y1}) - ({y2} - {y1}) * ({x0} - {x1}))"
        return f"(CASE WHEN {s} = 0 THEN ({y2} - {y1}) * ({x2} - {x1}) <= 0 ELSE ({s} > 0) = ({x2} > {x1}) END)"

    s = f"(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x0} - {x1}))"
    up = f"(({x1} > {x0}) <> ({x2} > {x0})) AND {passed(y)} AND NOT {passed(y0)}"
    across = (f"(({y1} > {y}) <> ({y2} > {y})) AND {s} <> 0 AND ({s} > 0) = ({y2} > {y1}) "
              f"AND NOT {geo._sql_crosses(x1, y1, x2, y2, x, y)}")
    return geo._sql_on_edge(x1, y1, x2, y2, x, y), f"(CASE WHEN {up} THEN 1 ELSE 0 END + CASE WHEN {across} THEN 1 ELSE 0 END)"


def inside_sql(e: str, odd: str, x: str, y: str, x0: str, y0: str) -> str:
    """Whether the point (x, y) lies strictly inside, given the edges ``e`` that meet the rectangle between
    it and the corner (x0, y0) at or below and left of it, and whether the corner is inside.

    A few edges run as generated code, more in one loop.
    """
    k, n = UNROLL, f"size({e}.x1)"
    few = [_crossings(e, i, x, y, x0, y0) for i in range(k)]
    touch = " OR ".join(f"({i} < {n} AND {t})" for i, (t, _) in enumerate(few))
    count = " + ".join(f"(CASE WHEN {i} < {n} THEN {c} ELSE 0 END)" for i, (_, c) in enumerate(few))
    t, c = _crossings(e, "i_", x, y, x0, y0)
    slow = (f"aggregate(sequence(0, {n} - 1), 0, (acc_, i_) -> CASE WHEN acc_ < 0 THEN acc_ WHEN {t} THEN -1 "
            f"ELSE acc_ + {c} END)")
    start = f"CASE WHEN {odd} THEN 1 ELSE 0 END"
    return (f"(CASE WHEN {n} = 0 THEN {odd} WHEN {n} <= {k} THEN NOT ({touch}) AND ({start} + {count}) % 2 = 1 "
            f"ELSE exists(array({slow}), v_ -> v_ >= 0 AND ({start} + v_) % 2 = 1) END)")


def holds_point(lon: str, lat: str, edges: bool = True) -> Column:
    """The exact test of a row of ``covering`` joined to a point of its cell; ``edges``: whether there are rows
    with edges."""
    b = f"(`{lon}` > _sb.min_lon AND `{lon}` < _sb.max_lon AND `{lat}` > _sb.min_lat AND `{lat}` < _sb.max_lat)"
    return F.expr(f"CASE WHEN _rect THEN {b} ELSE _odd END" if not edges else f"CASE WHEN _rect THEN {b} ELSE "
                  + inside_sql("_edges", "_odd", f"`{lon}`", f"`{lat}`", "(g_cx * _size)", "(g_cy * _size)") + " END")


def polygon_holds_point(edges: str, box: str, lon: str, lat: str) -> Column:
    """X6 for one polygon and one point: the same test from a corner outside the bounding box."""
    inside = inside_sql(edges, "false", lon, lat, f"({box}.min_lon - 1D)", f"({box}.min_lat - 1D)")
    return F.expr(f"{lon} > {box}.min_lon AND {lon} < {box}.max_lon AND {lat} > {box}.min_lat AND {lat} < {box}.max_lat "
                  f"AND {inside}")
