"""The iterative queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions import BFS, SSSP, SSWP, pagerank_kernel, personalised_pagerank_kernel, php_kernel
from deltaweave.operators.components import components
from deltaweave.operators.fixpoint import Rounds, with_own_rows, dense, run_select, run_sum
from deltaweave.session import cut
from deltaweave.sources.graph import Graph


def bfs(g: Graph, source: int, sentinel: bool = False) -> DataFrame:
    return dense(g, run_select(g, BFS, source), BFS, sentinel)


def sssp(g: Graph, source: int, sentinel: bool = False) -> DataFrame:
    return dense(g, run_select(g, SSSP, source), SSSP, sentinel)


def sswp(g: Graph, source: int, sentinel: bool = False) -> DataFrame:
    return dense(g, run_select(g, SSWP, source), SSWP, sentinel)


def connected_components(g: Graph) -> DataFrame:
    """(id, value): least id of each vertex's component, in rounds that grow with the logarithm of its size.

    The graph must be undirected. ``run_select(g, CC)`` gives parents too, which repairs need.
    """
    if g.directed:
        raise ValueError("connected components need an undirected graph")
    roots = components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.join(roots, g.vertices["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("value"))


def pagerank(g: Graph, how: Rounds, damping: float = 0.85) -> DataFrame:
    return run_sum(g, pagerank_kernel(damping), how)


def personalised_pagerank(g: Graph, source: int, how: Rounds, damping: float = 0.85) -> DataFrame:
    return run_sum(g, personalised_pagerank_kernel(source, damping), how)


def php(g: Graph, source: int, how: Rounds, damping: float = 0.8) -> DataFrame:
    return run_sum(g, php_kernel(source, damping), how)


def iterate_until(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, DataFrame], bool] | None = None, most: int = 100, cut_every: int = 5) -> DataFrame:
    """The generic superstep loop: ``step`` until ``done(old, new)`` or ``most`` steps.

    With ``done`` every step is cut and tested; without it only every ``cut_every`` steps are cut.
    """
    for k in range(1, most + 1):
        new = step(state)
        if done is not None or k % cut_every == 0 or k == most:
            new = cut(new)
        if done is not None and done(state, new):
            return new
        state = new
    return state


def _moved(tolerance: float) -> Callable[[DataFrame, DataFrame], bool]:
    """True when values moved by less than ``tolerance`` in all, but moved."""

    def done(old: DataFrame, new: DataFrame) -> bool:
        moved = new.agg(F.sum(F.abs(F.col("value") - F.col("last")))).first()[0] or 0.0
        return 0 < moved < tolerance

    return done


def php_fixed_rounds(g: Graph, source: int, rounds: int = 10, damping: float = 0.8, tolerance: float | None = None) -> DataFrame:
    """Penalised hitting probability by whole-vector rounds: r(source) is 1 again after each round.

    With ``tolerance`` it stops when a round moves values by less than that in all.
    """
    links = with_own_rows(php_kernel(source, damping).factors(g.edges), g.vertices, "factor")
    own, fresh = F.col("own"), F.when(F.col("id") == source, 1.0).otherwise(0.0)

    def step(state: DataFrame) -> DataFrame:
        met = links.met(state, F.lit(True))
        rows = met.select(F.col("dst").alias("id"), F.when(own, fresh).otherwise(F.col("value") * F.col("factor")).alias("value"), F.when(own, F.col("value")).otherwise(0.0).alias("last"))
        return rows.groupBy("id").agg(F.sum("value").alias("value"), F.sum("last").alias("last"))

    start = g.vertices.select("id", fresh.alias("value"), F.lit(0.0).alias("last"))
    try:
        return iterate_until(start, step, _moved(tolerance) if tolerance else None, rounds).select("id", "value")
    finally:
        links.unpersist()


def pagerank_with_sinks(g: Graph, rounds: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """Whole-vector PageRank that spreads what sinks hold over all vertices, one round late; starts at 0."""
    n = g.vertices.count()
    links = with_own_rows(pagerank_kernel(damping).factors(g.edges), g.vertices, "factor")
    sinks = g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").withColumn("_sink", F.lit(True))
    start = cut(g.vertices.join(sinks, "id", "left").select("id", F.coalesce("_sink", F.lit(False)).alias("sink"), F.lit(0.0).alias("value"), F.lit(0.0).alias("last")))
    own = F.col("own")

    def step(state: DataFrame) -> DataFrame:
        # the sum over sinks is one number for each round; the state is cut, so asking for it is cheap
        spread = state.agg(F.sum(F.when(F.col("sink"), F.col("last")))).first()[0] or 0.0
        met = links.met(state, F.lit(True))
        value = F.when(own, F.lit((1 - damping + damping * spread) / n)).otherwise(F.col("value") * F.col("factor"))
        rows = met.select(F.col("dst").alias("id"), (own & F.col("sink")).alias("sink"), value.alias("value"), F.when(own, F.col("value")).otherwise(0.0).alias("last"))
        return rows.groupBy("id").agg(F.max("sink").alias("sink"), F.sum("value").alias("value"), F.sum("last").alias("last"))

    try:
        return iterate_until(start, step, _moved(tolerance) if tolerance else None, rounds, cut_every=1).select("id", "value")
    finally:
        links.unpersist()
