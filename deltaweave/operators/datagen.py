"""Derived data sets: update batches, reweighted, enlarged and renumbered graphs.

Choices are made by arithmetic on the edge's ends and a seed, so they repeat on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.session import cut, materialize
from deltaweave.sources.graph import endpoints
from deltaweave.sources.tables import dealt, dense_rank_in_order

# Fixed value: a prime modulus for choices in parts of ten thousand.
MODULUS = 10007


def ticket(seed: int = 10) -> Column:
    """A number from 0 to MODULUS - 1 for each edge."""
    return ((F.col("src") % MODULUS) * 7919 + (F.col("dst") % MODULUS) * 104729 + seed) % MODULUS


def split_updates(edges: DataFrame, share: float, seed: int = 10, keep: int = 2, least: float = 0.2) -> DataFrame:
    """(src, dst, weight, part): ``base`` edges stay, ``add`` edges come in an update, ``delete`` edges go.

    Half of ``share`` are adds (not in the base graph), half deletes. A vertex keeps at least ``keep`` of
    its out-edges and the share ``least`` of them: of those chosen, the ones with the least tickets go.
    """
    half = int(share * MODULUS / 2)
    order = F.row_number().over(Window.partitionBy("src", "_chosen").orderBy("_t", "dst", "weight"))
    chosen = edges.withColumn("_t", ticket(seed)).withColumn("_chosen", F.col("_t") < 2 * half)
    degree = edges.groupBy("src").agg(F.count("*").alias("_deg"))
    may = F.col("_deg") - F.greatest(F.lit(keep), F.ceil(F.col("_deg") * least))
    ranked = chosen.where("_chosen").withColumn("_r", order)  # of a vertex only the chosen edges meet in a window
    rest = chosen.where("not _chosen").withColumn("_r", F.lit(0))
    part = F.when(~F.col("_chosen") | (F.col("_r") > may), "base").when(F.col("_t") < half, "add").otherwise("delete")
    return ranked.unionByName(rest).join(degree, "src").select("src", "dst", "weight", part.alias("part"))


def split_by_position(lines: DataFrame, share: float, n: int | None = None) -> DataFrame:
    """(line, src, dst, weight, part): of ``lines`` numbered from 0 the last half of the share are deletes, the half before adds."""
    n = lines.count() if n is None else n
    half = int(n * share / 2)
    part = F.when(F.col("line") >= n - half, "delete").when(F.col("line") >= n - 2 * half, "add").otherwise("base")
    return lines.select("line", "src", "dst", "weight", part.alias("part"))


def by_first_appearance(lines: DataFrame) -> DataFrame:
    """Edges (line, src, dst, weight) with dense ids from 0 in the order in which ids first appear, without self-loops.

    The source of a line comes before its target.
    """
    at = lines.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (F.col("line") * 2).alias("at")), F.struct(F.col("dst").alias("id"), (F.col("line") * 2 + 1).alias("at")))).alias("x"))
    first = at.groupBy("x.id").agg(F.min("x.at").alias("at"))
    ids = dense_rank_in_order(first, "at").select("id", "new_id")
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("_a")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("_b"))
    return lines.where("src <> dst").join(a, "src").join(b, "dst").select("line", F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight")


def generate(lines: DataFrame, share: float, top: int = 64, seed: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A data set from raw numbered lines: ids by first appearance, random weights, no sinks; base edges, updates, updated edges."""
    named = cut(by_first_appearance(cut(lines)).select("src", "dst", "weight"))
    edges = random_weights(close_sinks(named).groupBy("src", "dst").agg(F.min("weight").alias("weight")), top, seed)
    return split_graphs(cut(split_updates(cut(edges), share, seed)))


def vertex_order(clusters: DataFrame) -> DataFrame:
    """(id, position): vertices in the order of their clusters, dense from 0, so that a cluster lies together.

    Clusters are numbered by their least member, which names them, and members follow by id.
    """
    least = clusters.groupBy("cluster").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    ranked = dense_rank_in_order(least, "least", "k")
    tops = ranked.withColumn("_t", F.expr(f"k div {1 << 16}"))
    heads = tops.groupBy("_t").agg(F.sum("n").alias("m"))
    heads = heads.select("_t", (F.sum("m").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("base"))
    run = F.sum("n").over(Window.partitionBy("_t").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    starts = tops.withColumn("_s", run - F.col("n")).join(F.broadcast(heads), "_t").select("cluster", (F.col("_s") + F.col("base")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("id")) - 1
    return clusters.withColumn("_r", rank).join(starts, "cluster").select("id", (F.col("start") + F.col("_r")).cast("long").alias("position"))


def split_graphs(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``split_updates``: the base edges, the update batch and the updated edges."""
    e = parts.select("src", "dst", "weight", "part")
    updates = e.where("part <> 'base'").select(F.when(F.col("part") == "add", "a").otherwise("d").alias("op"), "src", "dst", "weight")
    return e.where("part <> 'add'").drop("part"), updates, e.where("part <> 'delete'").drop("part")


def reweight(edges: DataFrame, share: float = 0.01, top: int = 64, seed: int = 10) -> DataFrame:
    """A batch that gives a share of the edges a new weight 1..top: a delete and an add for each."""
    chosen = edges.where(ticket(seed) < int(share * MODULUS))
    new = (F.col("weight") * 7 + F.col("src") + F.col("dst")) % top + 1
    return chosen.select(F.explode(F.array(F.struct(F.lit("d").alias("op"), "src", "dst", "weight"), F.struct(F.lit("a").alias("op"), "src", "dst", new.cast("long").alias("weight")))).alias("u")).select("u.*")


def enlarge(edges: DataFrame, copies: int, source: int = 0, weight: int = 1) -> DataFrame:
    """``copies`` of the graph with shifted ids, and an edge from ``source`` to its image in each other copy."""
    width = edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("_w"))
    shifted = edges.crossJoin(F.broadcast(width)).select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_k"))
    images = shifted.select((F.col("src") + F.col("_k") * F.col("_w")).alias("src"), (F.col("dst") + F.col("_k") * F.col("_w")).alias("dst"), "weight")
    links = width.select(F.explode(F.sequence(F.lit(1), F.lit(max(copies - 1, 1)))).alias("_k"), "_w").where(F.col("_k") < copies)
    return images.unionByName(links.select(F.lit(source).cast("long").alias("src"), (source + F.col("_k") * F.col("_w")).alias("dst"), F.lit(weight).cast("long").alias("weight")))


def relabel(edges: DataFrame) -> DataFrame:
    """Edges with dense ids from 0 in the order of the old ids, without self-loops."""
    edges = materialize(edges.select("src", "dst", "weight"), "edges")
    ids, n = materialize(dense_rank_in_order(endpoints(edges)), "ids"), edges.count()
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("_a")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("_b"))
    half = dealt(edges.where("src <> dst"), n, "src").join(a, "src").select("_a", "dst", "weight")
    return dealt(half, n, "dst").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight")


def close_sinks(edges: DataFrame) -> DataFrame:
    """Adds an edge of weight 1 back to the least in-neighbour for each vertex without out-edges."""
    sinks = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("back")).join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    return edges.unionByName(sinks.select(F.col("id").alias("src"), F.col("back").alias("dst"), F.lit(1).cast("long").alias("weight")))


def random_weights(edges: DataFrame, top: int = 64, seed: int = 10) -> DataFrame:
    return edges.select("src", "dst", (ticket(seed) % top + 1).cast("long").alias("weight"))


def unweighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1).cast("long").alias("weight"))


def result_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-5, ignore_from: float = 1e15) -> DataFrame:
    """One row (n_both, n_left, n_right, sum_diff, n_diff) for two results (id, value); huge values are ignored."""
    x, y = (d.where(F.coalesce(F.abs("value") < ignore_from, F.lit(True))).select("id", F.col("value").alias(n)) for d, n in ((a, "x"), (b, "y")))
    d = F.abs(F.col("x") - F.col("y"))
    zero = F.lit(0).cast("long")
    return x.withColumn("l", F.lit(1)).join(y.withColumn("r", F.lit(1)), "id", "full_outer").agg(
        F.coalesce(F.sum(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)), zero).alias("n_both"), F.coalesce(F.sum(F.when(F.col("r").isNull(), 1)), zero).alias("n_left"),
        F.coalesce(F.sum(F.when(F.col("l").isNull(), 1)), zero).alias("n_right"), F.coalesce(F.sum(d), F.lit(0.0)).cast("double").alias("sum_diff"), F.coalesce(F.sum(F.when(d > tolerance, 1)), zero).alias("n_diff"),
    )
