"""Connected components of a large graph as Spark joins (alternating large star / small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over directed links (u, v) that hold every neighbour v of u.

    Each u takes m, the smallest of itself and its neighbours; its neighbours (the larger ones
    only, in a large star) and, in a small star, u itself are linked to m. The minimum is a
    partial aggregate joined back, so a hub's neighbours are never gathered in one place.
    """
    low = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = links.join(low, "u")
    if larger_only:
        return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (near.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .filter("a <> b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Every round is checkpointed to the shared folder. A graph needs O(log^2) rounds; they end when
    nothing changes, however many it takes. Self links and repeated
    links are allowed, null ends are ignored; no edges give no rows.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct())
    seen = None
    while True:
        both = e.selectExpr("a u", "b v").unionByName(e.selectExpr("b u", "a v"))
        large = _star(both, True).distinct()
        small = _star(large.selectExpr("greatest(a, b) u", "least(a, b) v"), False).distinct()
        e = saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # stars only: no node is both a larger and a smaller end, and the links stopped changing
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return e.selectExpr("a node", "b root").unionByName(e.selectExpr("b node", "b root").distinct())
