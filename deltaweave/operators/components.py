"""Components of undirected edges by alternating stars, in rounds that grow with the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm of a
    component's size. Only aggregates and equality joins: a hub's neighbours are never gathered.
    """
    e = materialize(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a > b").distinct(), "links")
    mark = _mark(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("explode(array(struct(a, m as b), struct(b as a, m as b))) as x").select("x.a", "x.b").where("a > b").distinct()
        new = materialize(small, "links")
        new_mark = _mark(new)
        if new_mark == mark:
            discard(e)
            roots = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        discard(e)
        e, mark = new, new_mark


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges, as a cheap test for equality."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
