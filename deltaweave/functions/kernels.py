"""Declarative kernels.

A *sum* kernel gives each edge a factor and each vertex an initial delta; values are sums of deltas
that flow along edges times the factor. A *select* kernel extends a value over an edge and keeps the
least or greatest offer. Both are Column expressions, so rounds stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.sources.graph import Graph


@dataclass(frozen=True)
class SumKernel:
    """``init(id, n)`` is the initial delta; ``factors(edges)`` gives (src, dst, factor), where a source's factors come from its own edges alone."""

    name: str
    init: Callable[[Column, int], Column]
    factors: Callable[[DataFrame], DataFrame]

    def start(self, g: Graph, n: int) -> DataFrame:
        return g.vertices.select("id", F.lit(0.0).alias("value"), self.init(F.col("id"), n).cast("double").alias("delta"))


@dataclass(frozen=True)
class SelectKernel:
    """``extend(value, weight)`` is an offer over an edge; ``least`` says which offers win.

    ``own`` kernels start at every vertex with its own id, others at a source with ``origin``.
    ``unreachable`` renders vertices without a value.
    """

    name: str
    extend: Callable[[Column, Column], Column]
    least: bool = True
    origin: int = 0
    own: bool = False
    unreachable: int | None = None

    def key(self, value: Column) -> Column:
        return value if self.least else -value

    def start(self, g: Graph, source: int | None) -> DataFrame:
        v = g.vertices if self.own else g.vertices.where(F.col("id") == source)
        return v.select("id", (F.col("id") if self.own else F.lit(self.origin)).cast("long").alias("value"), F.lit(None).cast("long").alias("parent"))


# Fixed value: the greatest 32-bit integer stands for "unreachable" and for an unlimited width.
INT_MAX = 2147483647

BFS = SelectKernel("bfs", lambda value, weight: value + 1, unreachable=INT_MAX)
SSSP = SelectKernel("sssp", lambda value, weight: value + weight, unreachable=INT_MAX)
SSWP = SelectKernel("sswp", lambda value, weight: F.least(value, weight), least=False, origin=INT_MAX, unreachable=0)
CC = SelectKernel("cc", lambda value, weight: value, own=True)


def _by_out_degree(damping: float) -> Callable[[DataFrame], DataFrame]:
    def factors(edges: DataFrame) -> DataFrame:
        degree = edges.groupBy("src").agg(F.count("*").alias("_deg"))
        return edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("_deg")).alias("factor"))

    return factors


def pagerank_kernel(damping: float = 0.85) -> SumKernel:
    """Without redistribution of what sinks hold: ranks sum to less than 1 if there are sinks."""
    return SumKernel("pagerank", lambda i, n: F.lit((1 - damping) / n), _by_out_degree(damping))


def personalised_pagerank_kernel(source: int, damping: float = 0.85) -> SumKernel:
    return SumKernel("ppr", lambda i, n: F.when(i == source, (1 - damping) / n).otherwise(0.0), _by_out_degree(damping))


def php_kernel(source: int, damping: float = 0.8) -> SumKernel:
    """Penalised hitting probability: edges into the source are dropped, the others normalised by weight."""

    def factors(edges: DataFrame) -> DataFrame:
        kept = edges.where(F.col("dst") != source)
        sums = kept.groupBy("src").agg(F.sum("weight").cast("double").alias("_sum"))
        return kept.join(sums, "src").select("src", "dst", (damping * F.col("weight") / F.nullif("_sum", F.lit(0.0))).alias("factor")).where("factor is not null")

    return SumKernel("php", lambda i, n: F.when(i == source, 1.0).otherwise(0.0), factors)
