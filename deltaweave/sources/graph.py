"""The data model: one directed multigraph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.session import materialize

EDGE = ("src", "dst", "weight")


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst, weight)``; parallel edges and self-loops are kept."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """Normalised columns; without ``vertices`` they are the distinct endpoints of the edges.

        An undirected graph stores both directions of every edge.
        """
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1).cast("long")
        e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), weight.alias("weight"))
        v = vertices.select(F.col("id").cast("long")).distinct() if vertices is not None else endpoints(e)
        return Graph(v, e if directed else e.unionByName(reverse(e)), directed)

    def unknown_endpoints(self) -> DataFrame:
        """Endpoints that aren't vertices."""
        return endpoints(self.edges).join(self.vertices, "id", "left_anti")

    def validate(self) -> Graph:
        """Raises if an edge has an unknown endpoint."""
        if not self.unknown_endpoints().isEmpty():
            raise ValueError("edges with endpoints outside the vertex set")
        return self

    def cached(self) -> Graph:
        """Edges dealt by ``src`` and kept (recomputed if an executor is lost)."""
        return replace(self, vertices=self.vertices.persist(StorageLevel.MEMORY_AND_DISK), edges=self.edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def hash_partitioned(self, n: int) -> Graph:
        return replace(self, edges=self.edges.repartition(n, "src"))

    def range_partitioned(self, n: int) -> Graph:
        return replace(self, edges=self.edges.repartitionByRange(n, "src"))

    def save(self, path: str) -> None:
        self.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(spark, path: str, directed: bool = True) -> Graph:
        return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), directed)


def kept(g: Graph, ends: bool = False) -> Graph:
    """``g`` written to the scratch folder, since it is read many times; with ``ends`` its vertices are found from the written edges."""
    e = materialize(g.edges, "edges")
    return replace(g, vertices=materialize(endpoints(e) if ends else g.vertices, "vertices"), edges=e)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct endpoints; each row gives both in one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
