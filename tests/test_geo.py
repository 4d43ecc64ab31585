import random

import exact_forms
from pyspark.sql import functions as F

from uas_spark.functions import geo
from uas_spark.operators import covering, spatial

# Fixed test square of the reference's weather tests (lon, lat).
SQUARE = [(-122.42, 47.61), (-122.40, 47.61), (-122.40, 47.63), (-122.42, 47.63)]


def _rings_lit(rings):
    return F.array(*[F.array(*[geo.vertex(F.lit(x), F.lit(y)) for x, y in r]) for r in rings])


def _eval(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def _closed(r):
    return list(r) + [r[0]]


def test_contains_inside_outside_boundary(spark):
    sq = _rings_lit([_closed(SQUARE)])
    assert _eval(spark, exact_forms.contains_point(sq, F.lit(-122.41), F.lit(47.62)))
    assert not _eval(spark, exact_forms.contains_point(sq, F.lit(0.0), F.lit(0.0)))
    # boundary (edge and vertex) is not contained
    assert not _eval(spark, exact_forms.contains_point(sq, F.lit(-122.40), F.lit(47.62)))
    assert not _eval(spark, exact_forms.contains_point(sq, F.lit(-122.42), F.lit(47.61)))


def test_contains_hole_excluded(spark):
    shell = _closed([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    hole = _closed([(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)])
    r = _rings_lit([shell, hole])
    assert not _eval(spark, exact_forms.contains_point(r, F.lit(2.0), F.lit(2.0)))
    assert _eval(spark, exact_forms.contains_point(r, F.lit(0.5), F.lit(0.5)))
    assert not _eval(spark, exact_forms.contains_point(r, F.lit(1.0), F.lit(2.0)))  # on the hole's edge


def test_box_intersects_closed(spark):
    sq = _rings_lit([_closed(SQUARE)])
    assert _eval(spark, exact_forms.polygon_box_intersects(sq, -122.43, 47.60, -122.39, 47.64))   # engulfs
    assert _eval(spark, exact_forms.polygon_box_intersects(sq, -122.415, 47.615, -122.405, 47.625))  # inside
    assert _eval(spark, exact_forms.polygon_box_intersects(sq, -122.40, 47.62, -122.30, 47.70))  # touches edge
    assert not _eval(spark, exact_forms.polygon_box_intersects(sq, 0.0, 0.0, 1.0, 1.0))
    tri = _rings_lit([_closed([(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)])])
    assert not _eval(spark, exact_forms.polygon_box_intersects(tri, 1.8, 1.8, 2.0, 2.0))  # bbox overlaps, shape not
    assert _eval(spark, exact_forms.polygon_box_intersects(tri, 1.4, 1.1, 2.0, 2.0))


def test_disc_box_radius_in_metres(spark):
    # 0.001 deg of latitude is ~111 m
    box = (-122.40, 47.621, -122.39, 47.63)
    assert _eval(spark, geo.disc_box_intersects(F.lit(47.62), F.lit(-122.395), F.lit(150.0), *box))
    assert not _eval(spark, geo.disc_box_intersects(F.lit(47.62), F.lit(-122.395), F.lit(80.0), *box))
    assert not _eval(spark, geo.disc_box_intersects(F.lit(47.625), F.lit(-122.395), F.lit(0.0), *box))


def _ray(x, y, rings):
    inside = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def test_random_triangles_against_python_ray_caster(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        tri = [(rnd.randint(0, 64) / 16, rnd.randint(0, 64) / 16) for _ in range(3)]
        x, y = rnd.randint(1, 255) / 64 + 1 / 128, rnd.randint(1, 255) / 64 + 1 / 128
        rows.append((i, [[{"lon": a, "lat": b} for a, b in _closed(tri)]], x, y, _ray(x, y, [_closed(tri)])))
    df = spark.createDataFrame(rows, "i int, rings array<array<struct<lon:double,lat:double>>>, x double, "
                                     "y double, expect boolean")
    got = df.select("expect", exact_forms.contains_point(F.col("rings"), F.col("x"), F.col("y")).alias("got")).collect()
    assert all(r["got"] == r["expect"] for r in got)


def test_grid_levels_bound_the_cells(spark):
    rows = [(47.0, -123.0, 47.1, -122.9), (40.0, -130.0, 50.0, -110.0), (-89.0, -179.9, 89.0, 179.9), (1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").select(
        geo.normalize_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    for levels in (None, F.array(*[F.lit(k) for k in range(geo.TOP_LEVEL + 1)])):
        n = [r["count"] for r in geo.explode_box_cells(df, "box", levels).groupBy("box").count().collect()]
        assert len(n) == 4 and max(n) <= 81 + 9 * geo.TOP_LEVEL
    assert {r.g_own for r in geo.explode_box_cells(df, "box").collect()} == {0, 2, 4}


def _sat_meets(tri, box):
    """Exact closed triangle-box intersection by separating axes (rational arithmetic)."""
    from fractions import Fraction as Fr
    tri = [(Fr(x), Fr(y)) for x, y in tri]
    bx0, by0, bx1, by1 = [Fr(v) for v in box]
    if max(x for x, _ in tri) < bx0 or min(x for x, _ in tri) > bx1:
        return False
    if max(y for _, y in tri) < by0 or min(y for _, y in tri) > by1:
        return False
    corners = [(bx0, by0), (bx1, by0), (bx1, by1), (bx0, by1)]
    for i in range(3):
        (x1, y1), (x2, y2) = tri[i], tri[(i + 1) % 3]
        nx, ny = y2 - y1, x1 - x2
        tp = [nx * x + ny * y for x, y in tri]
        bp = [nx * x + ny * y for x, y in corners]
        if max(tp) < min(bp) or max(bp) < min(tp):
            return False
    return True


def test_random_triangle_box_against_exact_sat(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(300):
        tri = [(rnd.randint(0, 32) / 8, rnd.randint(0, 32) / 8) for _ in range(3)]
        if (tri[1][0] - tri[0][0]) * (tri[2][1] - tri[0][1]) == (tri[2][0] - tri[0][0]) * (tri[1][1] - tri[0][1]):
            continue  # degenerate
        x0, y0 = rnd.randint(0, 32) / 8, rnd.randint(0, 32) / 8
        box = (x0, y0, x0 + rnd.randint(0, 8) / 8, y0 + rnd.randint(0, 8) / 8)
        rows.append((i, [[{"lon": a, "lat": b} for a, b in _closed(tri)]], *box, _sat_meets(tri, box)))
    df = spark.createDataFrame(rows, "i int, rings array<array<struct<lon:double,lat:double>>>, bx0 double, "
                                     "by0 double, bx1 double, by1 double, expect boolean")
    e = F.expr(geo.edges_sql("rings"))
    df = df.withColumn("_edges", e)
    got = df.select("expect", exact_forms.polygon_box_intersects(F.col("rings"), "bx0", "by0", "bx1", "by1").alias("a"),
                    F.expr(geo.box_meets_edges_sql("_edges", "bx0", "by0", "bx1", "by1")).alias("c")).collect()
    assert all(r["a"] == r["expect"] and r["c"] == r["expect"] for r in got)


def test_point_test_from_a_corner_agrees(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        pts = [(rnd.randint(0, 16) / 4, rnd.randint(0, 16) / 4) for _ in range(rnd.randint(3, 12))]
        rows.append((i, [[{"lon": a, "lat": b} for a, b in _closed(pts)]], rnd.randint(0, 64) / 16,
                     rnd.randint(0, 64) / 16))
    df = spark.createDataFrame(rows, "i int, rings array<array<struct<lon:double,lat:double>>>, x double, y double")
    df = df.withColumn("_edges", F.expr(geo.edges_sql("rings"))).withColumn("_sb", F.expr(geo.bbox_sql("rings")))
    got = df.select("i", exact_forms.contains_point(F.col("rings"), F.col("x"), F.col("y")).alias("whole"),
                    covering.polygon_holds_point("_edges", "_sb", "x", "y").alias("corner")).collect()
    assert all(r.whole == r.corner for r in got)


def _rings(rnd, n, cx, cy, r, steps, least=0.4):
    """A star-like ring of n vertices on a fine or coarse lattice, so that points, edges and cells often touch."""
    import math
    pts = []
    for k in range(n):
        a, q = 2 * math.pi * k / n, r * rnd.uniform(least, 1)
        pts.append((round((cx + q * math.cos(a)) * steps) / steps, round((cy + q * math.sin(a)) * steps) / steps))
    return [{"lon": x, "lat": y} for x, y in pts + [pts[0]]]


def test_coverings_equal_the_whole_ring_test(spark):
    rnd = random.Random(11)
    shapes = []
    for i in range(60):
        cx, cy, r = rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.choice([0.05, 0.4, 2.5])
        steps = rnd.choice([16, 64, 1024])
        rings = [_rings(rnd, rnd.choice([3, 4, 5, 9, 40]), cx, cy, r, steps)]
        if i % 3 == 0:
            rings.append(_rings(rnd, 5, cx, cy, r / 3, steps))
        shapes.append((i, rings))
    sh = spark.createDataFrame(shapes, "k int, rings array<array<struct<lon:double,lat:double>>>")
    pts = [(j, rnd.randint(-96, 96) / 32, rnd.randint(-96, 96) / 32) for j in range(900)]
    pts += [(900 + j, v["lon"], v["lat"]) for j, v in enumerate(v for _, rs in shapes for r in rs for v in r)]
    p = spark.createDataFrame(pts, "j int, lon double, lat double")
    got = {(r.j, r.k) for r in spatial.points_in_shapes(p, sh, "rings", ["k"]).collect()}
    want = {(r.j, r.k) for r in p.crossJoin(sh).filter(
        exact_forms.contains_point(F.col("rings"), F.col("lon"), F.col("lat"))).collect()}
    assert got == want and len(want) > 200
    cov = covering.covering(sh, ["k"], "rings").filter("NOT _rect")
    assert cov.filter("size(_edges.x1) = 0").count() > 0
    assert cov.groupBy("k").count().agg(F.max("count")).first()[0] <= 81


def test_large_polygons_join_by_their_cells(spark):
    """A polygon of 10,000 vertices with a hole: no cell holds more than a part of its edges."""
    rnd = random.Random(3)
    rings = [_rings(rnd, 10_000, 0.0, 0.0, 2.0, 1 << 20, 0.99), _rings(rnd, 3_000, 0.0, 0.0, 0.5, 1 << 20, 0.99)]
    sh = spark.createDataFrame([(1, rings)], "k int, rings array<array<struct<lon:double,lat:double>>>")
    p = spark.createDataFrame([(i, rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(100_000)],
                              "id long, lon double, lat double")
    assert covering.covering(sh, ["k"], "rings").agg(F.max(F.size("_edges.x1"))).first()[0] < 400
    inside = {r.id for r in spatial.points_in_shapes(p, sh, "rings", ["k"]).collect()}

    def crosses(ring, x, y):
        n = 0
        for a, b in zip(ring, ring[1:]):
            if (a["lat"] > y) != (b["lat"] > y):
                n += x < (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return n

    for r in p.limit(200).collect():
        assert (r.id in inside) == (sum(crosses(ring, r.lon, r.lat) for ring in rings) % 2 == 1)


def test_disc_meets_box_exactly_up_to_the_poles(spark):
    import math
    rnd = random.Random(17)

    def dist(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))

    rows = []
    for i in range(300):
        y0 = rnd.choice([rnd.uniform(-89, 80), rnd.uniform(80, 89.9), 89.5])
        y1, x0 = min(90.0, y0 + rnd.uniform(0.01, 5)), rnd.uniform(-180, 150)
        x1 = x0 + rnd.uniform(0.01, 30)
        la, lo = max(-90.0, min(90.0, rnd.choice([y0, y1]) + rnd.uniform(-4, 4))), rnd.uniform(-180, 180)
        edge = [(y0 + (y1 - y0) * t / 400, x) for t in range(401) for x in (x0, x1)]
        edge += [(y, x0 + (x1 - x0) * t / 400) for t in range(401) for y in (y0, y1)]
        inside = y0 <= la <= y1 and (x0 <= lo <= x1 or x0 <= lo + 360 <= x1)
        d = 0.0 if inside else min(dist(la, lo, y, x) for y, x in edge)
        rows.append((i, la, lo, x0, y0, x1, y1, d))
    df = spark.createDataFrame(rows, "i int, la double, lo double, x0 double, y0 double, x1 double, y1 double, d double")
    slack = F.col("d") * 1e-3 + 50  # the dense sample's own error
    got = df.select("i", "d", geo.disc_box_intersects("la", "lo", F.col("d") + slack, "x0", "y0", "x1", "y1").alias("near"),
                    geo.disc_box_intersects("la", "lo", F.col("d") - slack, "x0", "y0", "x1", "y1").alias("far")).collect()
    assert all(r.near for r in got) and not any(r.far for r in got if r.d > 100)
