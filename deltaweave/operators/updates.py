"""Batches of edge inserts and deletes.

A batch is ``updates(op, src, dst, weight[, line])`` with op ``a`` or ``d``. An add on an existing
pair replaces it; a delete removes all parallel copies; a pair both deleted and added ends added; of
several adds of a pair the first (by ``line``, else the least weight) wins.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.session import cut
from deltaweave.sources.graph import Graph, reverse

PAIR = ["src", "dst"]


def normalise(updates: DataFrame, directed: bool = True) -> DataFrame:
    """One row per pair: (src, dst, op, weight); an undirected batch is mirrored."""
    order = "line" if "line" in updates.columns else "weight"
    u = updates.select("op", "src", "dst", "weight", F.col(order).alias("_o"))
    if not directed:
        u = u.unionByName(reverse(u))
    adds = F.col("op") == "a"
    return u.groupBy(*PAIR).agg(F.when(F.max(adds), "a").otherwise("d").alias("op"), F.min_by("weight", F.when(adds, F.struct("_o", "weight"))).alias("weight"))


def validate(g: Graph, updates: DataFrame) -> DataFrame:
    """``updates`` itself; raises if an endpoint isn't a vertex, since the vertex set is fixed."""
    ends = updates.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if not ends.join(g.vertices, "id", "left_anti").isEmpty():
        raise ValueError("updates with endpoints outside the vertex set")
    return updates


def apply_updates(g: Graph, updates: DataFrame) -> Graph:
    """The graph after the batch."""
    u = normalise(updates, g.directed)
    kept = g.edges.join(u, PAIR, "left_anti")
    added = u.where("op = 'a'").select("src", "dst", "weight")
    return replace(g, edges=kept.unionByName(added))


def effective(g: Graph, updates: DataFrame, normal: bool = False) -> DataFrame:
    """(op, src, dst, weight) rows that change the graph: removed copies ``d`` and added ones ``a``.

    Replacing a pair by the same single edge is no change. ``normal`` says that the batch is normalised.
    """
    u = (updates if normal else normalise(updates, g.directed)).withColumnRenamed("weight", "new_weight")
    old = g.edges.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("weight").alias("old_weight"), F.max("weight").alias("_top"))
    met = u.join(old, PAIR, "left").where("not (op = 'a' and n = 1 and old_weight <=> new_weight)")
    gone = g.edges.join(met.where("n is not null").select(*PAIR), PAIR, "left_semi").select(F.lit("d").alias("op"), "src", "dst", "weight")
    return gone.unionByName(met.where("op = 'a'").select("op", "src", "dst", F.col("new_weight").alias("weight")))


def updated(g: Graph, updates: DataFrame, most: int = 500_000) -> tuple[Graph, DataFrame]:
    """``apply_updates`` and ``effective`` together; a batch counted to be of at most ``most`` pairs is broadcast, so edges aren't shuffled."""
    u = cut(normalise(updates, g.directed))
    small = u.count() <= most
    pairs = F.broadcast(u.select(*PAIR)) if small else u.select(*PAIR)
    old = cut(g.edges.join(pairs, PAIR, "left_semi"))
    kept = g.edges.join(pairs, PAIR, "left_anti")
    added = u.where("op = 'a'").select("src", "dst", "weight")
    return replace(g, edges=kept.unionByName(added)), cut(effective(replace(g, edges=old), u, normal=True))


def changed_vertices(updates: DataFrame) -> DataFrame:
    """Distinct targets of deletes."""
    return updates.where("op = 'd'").select(F.col("dst").alias("id")).distinct()


def inverse(g: Graph, updates: DataFrame) -> DataFrame:
    """The batch that undoes ``updates`` on a graph without parallel edges."""
    eff = effective(g, updates)
    back = eff.where("op = 'd'").select(F.lit("a").alias("op"), "src", "dst", "weight")
    gone = eff.where("op = 'a'").join(eff.where("op = 'd'").select(*PAIR), PAIR, "left_anti")
    return back.unionByName(gone.select(F.lit("d").alias("op"), "src", "dst", F.lit(None).cast(dict(back.dtypes)["weight"]).alias("weight")))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each pair, once, with the least weight found for that direction of either."""
    return edges.unionByName(reverse(edges)).groupBy(*PAIR).agg(F.min("weight").alias("weight"))


def to_undirected_keep(edges: DataFrame) -> DataFrame:
    """As the script variant: the reverse of an edge is added only if absent, else it keeps its weight."""
    one = edges.groupBy(*PAIR).agg(F.min("weight").alias("weight"))
    return one.unionByName(reverse(one).select("src", "dst", "weight").join(one, PAIR, "left_anti"))
