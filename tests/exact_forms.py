"""Whole-ring forms of the exact geometry tests, to hold the operators' forms against."""

from pyspark.sql import functions as F

from uas_spark.functions.geo import _c


def _edge_ids(ring) :
    return F.sequence(F.lit(0), F.size(ring) - 2)


def contains_point(rings, lon, lat) :
    """Strict point-in-polygon (even-odd over all rings, boundary excluded)."""
    x, y = _c(lon), _c(lat)

    def on_edge(r, i):
        a, b = r[i], r[i + 1]
        cross = (b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"])
        return ((cross == 0)
                & (x >= F.least(a["lon"], b["lon"])) & (x <= F.greatest(a["lon"], b["lon"]))
                & (y >= F.least(a["lat"], b["lat"])) & (y <= F.greatest(a["lat"], b["lat"])))

    touches = F.exists(_c(rings), lambda r: F.exists(_edge_ids(r), lambda i: on_edge(r, i)))
    return _even_odd(rings, x, y) & ~touches


def _even_odd(rings, x, y) :
    def crosses(r, i):
        a, b = r[i], r[i + 1]
        dy = b["lat"] - a["lat"]
        x_at = (b["lon"] - a["lon"]) * (y - a["lat"]) / F.nullif(dy, F.lit(0.0)) + a["lon"]
        return F.coalesce(((a["lat"] > y) != (b["lat"] > y)) & (x < x_at), F.lit(False))

    n = F.aggregate(_c(rings), F.lit(0),
                    lambda acc, r: acc + F.size(F.filter(_edge_ids(r), lambda i: crosses(r, i))))
    return (n % 2) == 1


def polygon_box_intersects(rings, min_lon, min_lat, max_lon, max_lat) :
    """Closed polygon meets closed box.

    An edge meets the box iff their bounding boxes overlap and the edge's line
    does not leave all four corners strictly on one side (separating axes).
    If no edge meets the box, the box is wholly inside or outside, so testing
    one corner by even-odd decides.
    """
    bx0, by0, bx1, by1 = _c(min_lon), _c(min_lat), _c(max_lon), _c(max_lat)

    def edge_meets(r, i):
        a, b = r[i], r[i + 1]
        ex, ey = b["lon"] - a["lon"], b["lat"] - a["lat"]

        def side(cx, cy):
            return ex * (cy - a["lat"]) - ey * (cx - a["lon"])

        s = [side(bx0, by0), side(bx1, by0), side(bx1, by1), side(bx0, by1)]
        all_pos = (s[0] > 0) & (s[1] > 0) & (s[2] > 0) & (s[3] > 0)
        all_neg = (s[0] < 0) & (s[1] < 0) & (s[2] < 0) & (s[3] < 0)
        overlap = ((F.least(a["lon"], b["lon"]) <= bx1) & (F.greatest(a["lon"], b["lon"]) >= bx0)
                   & (F.least(a["lat"], b["lat"]) <= by1) & (F.greatest(a["lat"], b["lat"]) >= by0))
        return overlap & ~all_pos & ~all_neg

    any_edge = F.exists(_c(rings), lambda r: F.exists(_edge_ids(r), lambda i: edge_meets(r, i)))
    return any_edge | _even_odd(rings, bx0, by0)
