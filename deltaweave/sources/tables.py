"""Graphs derived from relational tables, and order-based numbering that needs no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph

WIDTH = 1 << 16
#: Rows of a task where many rows are sorted or told apart at once, so that its memory doesn't grow with the table.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows``, counted to be ``n``, dealt by the columns ``by`` into parts of about TASK_ROWS, but no fewer than the session's."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *by)


def lead_in_order(rows: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``out``: the value of the next row in the order of the unique non-negative ``key``.

    Windows run inside ranges of ``width`` keys; the last row of a range takes the first value of the
    next range that has rows, which the same scheme finds among the ranges. Only the top level, with
    one row for every ``width`` squared keys, is a single window.
    """
    cut = rows.withColumn("_b", F.expr(f"{key} div {width}"))
    firsts = cut.groupBy("_b").agg(F.min_by(value, key).alias("_v"))
    tops = firsts.withColumn("_t", F.expr(f"_b div {width}"))
    heads = tops.groupBy("_t").agg(F.min_by("_v", "_b").alias("_v"))
    heads = heads.select("_t", F.lead("_v").over(Window.orderBy("_t")).alias("_next_top"))
    nexts = tops.join(heads, "_t", "left").select("_b", F.coalesce(F.lead("_v").over(Window.partitionBy("_t").orderBy("_b")), "_next_top").alias("_next"))
    inside = cut.withColumn(out, F.lead(value).over(Window.partitionBy("_b").orderBy(key)))
    return inside.join(nexts, "_b", "left").withColumn(out, F.coalesce(out, "_next")).select(*rows.columns, out)


def dense_rank_in_order(ids: DataFrame, key: str = "id", out: str = "new_id", width: int = WIDTH) -> DataFrame:
    """Dense numbers from 0 in the order of the unique non-negative ``key``."""
    cut = ids.withColumn("_b", F.expr(f"{key} div {width}"))
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_t", F.expr(f"_b div {width}"))
    tops = sizes.groupBy("_t").agg(F.sum("_n").alias("_m"))
    tops = tops.select("_t", (F.sum("_m").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_base"))
    run = F.sum("_n").over(Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    before = sizes.join(tops, "_t").select("_b", (run - F.col("_n") + F.col("_base")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return cut.withColumn("_r", rank).join(before, "_b").select(*ids.columns, (F.col("_before") + F.col("_r")).cast("long").alias(out))


def customer_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed graph: from each order's customer to that of the next order; least weight of parallel edges."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("src"))
    steps = lead_in_order(orders, "o_orderkey", "src", "dst").where("dst is not null and src <> dst")
    edges = steps.groupBy("src", "dst").agg(F.min(1 + F.col("o_orderkey") % 64).alias("weight"))
    return Graph.of(edges)


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite graph of suppliers (even ids) and parts (odd ids)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = items.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return Graph.of(dealt(pairs, items.count(), "src", "dst").distinct(), directed=False)


def customer_updates(g: Graph, n_vertices: Column | int) -> DataFrame:
    """A fixed batch for ``customer_chain``: deletes by a hash of the edge, adds from every 50th vertex."""
    gone = g.edges.where("(src * 31 + dst) % 100 = 0").select(F.lit("d").alias("op"), "src", "dst", F.lit(None).cast("long").alias("weight"))
    new = g.vertices.where("id % 50 = 0").select(F.lit("a").alias("op"), F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n_vertices).alias("dst"), (1 + F.col("id") % 16).alias("weight"))
    new = new.join(g.vertices.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").select("op", "src", "dst", "weight")
    return gone.unionByName(new)
