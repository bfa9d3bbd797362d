"""Repair of results after a batch of updates, instead of a rerun."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.kernels import SelectKernel, SumKernel
from deltaweave.operators.fixpoint import Rounds, reduced, select_fixpoint, sum_fixpoint
from deltaweave.operators.updates import updated
from deltaweave.session import cut
from deltaweave.sources.graph import Graph


#: Rows of a batch, of its touched vertices or of a reset set that are broadcast at most.
SENT_ROWS = 500_000
#: Levels of the dependency tree that are walked one by one before pointers are doubled.
WALKED_LEVELS = 24


def sent(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` as a broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if (df.count() if n is None else n) <= SENT_ROWS else df


def retract_and_reissue(state: DataFrame, old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``state`` whose deltas take back what touched sources sent under ``old`` factors and send it under ``new``.

    Sources without an effective update sent the same before and after, so only touched ones count.
    """
    sender = sent(cut(state.join(touched, "id", "left_semi").select(F.col("id").alias("src"), "value")))
    sign = old.select("src", "dst", (-F.col("factor")).alias("factor")).unionByName(new.select("src", "dst", "factor"))
    back = sign.join(sender, "src").select(F.col("dst").alias("id"), F.lit(0.0).alias("value"), (F.col("value") * F.col("factor")).alias("delta"))
    return state.select("id", "value", "delta").unionByName(back).groupBy("id").agg(F.sum("value").alias("value"), F.sum("delta").alias("delta"))


def update_sum(g: Graph, state: DataFrame, updates: DataFrame, kernel: SumKernel, how: Rounds) -> tuple[Graph, DataFrame]:
    """The updated graph and the repaired (id, value, delta)."""
    after, eff = updated(g, updates)
    touched = sent(cut(eff.select(F.col("src").alias("id")).distinct()))
    n = g.vertices.count()
    of = touched.withColumnRenamed("id", "src")
    old, new = (kernel.factors(edges.join(of, "src", "left_semi")) for edges in (g.edges, after.edges))
    moved = cut(retract_and_reissue(state, old, new, touched))
    return after, sum_fixpoint(moved, kernel.factors(after.edges), n, how, ids=g.vertices, counted=after.edges)


def reset_set(state: DataFrame, removed: DataFrame, walked: int = WALKED_LEVELS) -> DataFrame:
    """Vertices whose value hangs on a removed edge: (id).

    ``state`` is (id, value, parent); the seeds are the targets whose parent is the removed edge's
    source, and the set is closed over parent pointers. Without the seeds' own pointers what is left is
    a forest, so every vertex is met once. Its levels below the seeds are walked three to a cut; below
    ``walked`` levels, as on a long path, pointers are doubled instead, in rounds that grow with the
    logarithm of the depth.
    """
    gone = removed.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct()
    seeds = cut(state.join(sent(gone), ["id", "parent"], "left_semi").select("id"))
    tree = state.where("parent is not null and parent <> id").select("id", "parent").join(sent(seeds), "id", "left_anti")
    found, level, n, depth = [seeds], seeds, seeds.count(), 0
    while n and depth < walked:
        deeper = []
        for _ in range(3):
            below = level if not deeper else deeper[-1]
            # the next level is a part of the tree; how large it is shows only when it is cut
            above = below.withColumnRenamed("id", "parent")
            deeper.append(tree.join(F.broadcast(above) if n <= SENT_ROWS // 64 else above, "parent", "left_semi").select("id"))
        marked = cut(reduce(DataFrame.unionByName, [d.withColumn("k", F.lit(k)) for k, d in enumerate(deeper)]))
        found.append(marked.select("id"))
        level, depth = marked.where("k = 2").select("id"), depth + 3
        n = level.count()
    if n:
        found.append(_below(tree, level))
    return reduce(DataFrame.unionByName, found)


def _below(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """All vertices below ``roots`` in the forest ``tree`` (id, parent), by doubling pointers."""
    jumps = cut(tree.join(roots.withColumn("_r", F.lit(True)).withColumnRenamed("id", "parent"), "parent", "left").select("id", "parent", F.coalesce("_r", F.lit(False)).alias("hit")))
    while True:
        above = jumps.select(F.col("id").alias("parent"), F.col("parent").alias("_p"), F.col("hit").alias("_h"))
        new = jumps.join(above, "parent", "left").select("id", F.when(F.col("hit"), F.col("parent")).otherwise(F.coalesce("_p", "parent")).alias("parent"), (F.col("hit") | F.coalesce("_h", F.lit(False))).alias("hit"), (~F.col("hit") & F.col("_p").isNotNull()).alias("moved"))
        new = cut(new)
        jumps = new.drop("moved")
        if new.where("moved").isEmpty():
            return jumps.where("hit").select("id")


def update_select(g: Graph, state: DataFrame, updates: DataFrame, kernel: SelectKernel, source: int | None = None) -> tuple[Graph, DataFrame]:
    """The updated graph and the repaired (id, value, parent) of reached vertices.

    What hangs on removed edges is reset to the kernel's start. The edges into the reset part and the
    added ones are offered what their sources hold; what improves by that, and reset vertices that start
    with a value, is the frontier. A weight change is a delete and an add, so increases are seen. Small
    batches and reset sets are broadcast, so edges and state are scanned where they are.
    """
    after, eff = updated(g, updates)
    reset = cut(reset_set(state, eff.where("op = 'd'")))
    gone = sent(reset)
    kept = state.join(gone, "id", "left_anti").select("id", "value", F.lit(-1).alias("round"), "parent")
    again = kernel.start(after, source).join(gone, "id", "left_semi").select("id", "value", F.lit(0).alias("round"), "parent")
    into = after.edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    edges = cut(into.unionByName(eff.where("op = 'a'").select("src", "dst", "weight")))
    met = kept.join(sent(edges), F.col("id") == F.col("src"))
    offers = met.select(F.col("dst").alias("id"), kernel.extend(F.col("value"), F.col("weight")).alias("value"), F.lit(0).alias("round"), F.col("src").alias("parent"))
    begin = cut(reduced(kept.unionByName(again).unionByName(offers), kernel))
    return after, select_fixpoint(begin, after.edges, kernel, ids=g.vertices)


def reset_statistics(state: DataFrame, reset: DataFrame) -> DataFrame:
    """Number and share of reset vertices, one row."""
    return reset.agg(F.count("*").alias("n_reset")).crossJoin(state.agg(F.count("*").alias("n"))).select("n_reset", (F.col("n_reset") / F.col("n")).alias("share"))
