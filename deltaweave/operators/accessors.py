"""Structure of a graph: degrees, adjacency, borders between labelled parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.sources.graph import Graph


def out_degree(g: Graph) -> DataFrame:
    """Rows are counted, so parallel edges count; every vertex is listed."""
    return _degree(g, "src")


def in_degree(g: Graph) -> DataFrame:
    return _degree(g, "dst")


def _degree(g: Graph, end: str) -> DataFrame:
    ones = g.edges.select(F.col(end).alias("id"), F.lit(1).cast("long").alias("one"))
    return ones.unionByName(g.vertices.select("id", F.lit(0).cast("long").alias("one"))).groupBy("id").agg(F.sum("one").alias("degree"))


def top_out_degree(g: Graph, k: int) -> DataFrame:
    """The k vertices of highest out-degree (ties: least id first)."""
    return out_degree(g).orderBy(F.desc("degree"), "id").limit(k)


def bottom_out_degree(g: Graph, k: int) -> DataFrame:
    """The k vertices of lowest out-degree (ties: least id first)."""
    return out_degree(g).orderBy("degree", "id").limit(k)


def counts(g: Graph) -> DataFrame:
    """n_vertices, n_edges."""
    return g.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(g.edges.agg(F.count("*").alias("n_edges")))


def neighbours(g: Graph, of: DataFrame, out: bool = True) -> DataFrame:
    """(id, neighbour, weight) of the vertices in ``of(id)``."""
    a, b = ("src", "dst") if out else ("dst", "src")
    return g.edges.join(of.select(F.col("id").alias(a)), a, "left_semi").select(F.col(a).alias("id"), F.col(b).alias("neighbour"), "weight")


def with_child(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_semi")


def with_parent(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("dst").alias("id")), "id", "left_semi")


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with ``src_label`` and ``dst_label``; null for vertices without a label. ``labels`` is (id, label)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def border(g: Graph, labels: DataFrame) -> DataFrame:
    """Vertices with edges over a border: (id, incoming, outgoing), one row for each such vertex."""
    over = labelled(g.edges, labels).where("not src_label <=> dst_label")
    ends = over.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(False).alias("i"), F.lit(True).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(True).alias("i"), F.lit(False).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.max("e.i").alias("incoming"), F.max("e.o").alias("outgoing"))


def destination_parts(g: Graph, labels: DataFrame, side: str = "out") -> DataFrame:
    """(id, label): the other parts that a vertex has out-edges into, in-edges from (``in``), or either (``both``)."""
    over = labelled(g.edges, labels).where("not src_label <=> dst_label")
    out = over.where("dst_label is not null").select(F.col("src").alias("id"), F.col("dst_label").alias("label"))
    into = over.where("src_label is not null").select(F.col("dst").alias("id"), F.col("src_label").alias("label"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[side].distinct()


def neighbours_within(g: Graph, labels: DataFrame, inner: bool = True, part: int | None = None) -> DataFrame:
    """(id, neighbour, weight): out-edges that stay in their part (or leave it), or those into one named part."""
    same = F.col("src_label") == F.col("dst_label")
    kept = F.col("dst_label") == part if part is not None else same if inner else ~F.coalesce(same, F.lit(False))
    return labelled(g.edges, labels).where(kept).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "weight")
