"""Forward passes of a graph convolution, and their repair after updates.

Features are arrays. A layer multiplies each vertex's features by the layer's weights (rectified
first, but for the first layer), pushes the product along out-edges and sums at the targets; there is
no self-loop. Weights are given as nested lists (in x out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.operators.updates import apply_updates, effective
from deltaweave.session import cut
from deltaweave.sources.graph import Graph


def default_dims(layers: int) -> list[int]:
    """16 * 2^layers, halving with each layer."""
    return [16 * 2 ** (layers - k) for k in range(layers + 1)]


def default_weights(n_in: int, n_out: int) -> list[list[float]]:
    """Deterministic weights 1..64 whose columns sum to 1."""
    raw = [[(31 * i + 17 * j) % 64 + 1 for j in range(n_out)] for i in range(n_in)]
    sums = [sum(row[j] for row in raw) for j in range(n_out)]
    return [[row[j] / sums[j] for j in range(n_out)] for row in raw]


def initial_features(g: Graph, dim: int) -> DataFrame:
    """feature[i] = id + i."""
    return g.vertices.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.col("id") + i).cast("double")).alias("feature"))


def _product(weights: list[list[float]], rectify: bool) -> Column:
    h = F.transform("feature", lambda x: F.greatest(x, F.lit(0.0))) if rectify else F.col("feature")
    columns = [F.array(*[F.lit(row[j]) for row in weights]) for j in range(len(weights[0]))]
    return F.array(*[F.aggregate(F.zip_with(h, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in columns])


def _pushed(features: DataFrame, edges: DataFrame, weights: list[list[float]], rectify: bool, sign: int = 1) -> DataFrame:
    """(id, one column for each output dimension): what the vertices in ``features`` send, not yet summed."""
    h = features.select(F.col("id").alias("src"), _product(weights, rectify).alias("_h"))
    return h.join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id"), *[(sign * F.col("_h")[j]).alias(f"_{j}") for j in range(len(weights[0]))])


def _summed(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy("id").agg(*[F.sum(f"_{j}").alias(f"_{j}") for j in range(n)]).select("id", F.array(*[f"_{j}" for j in range(n)]).alias("feature"))


def forward(g: Graph, features: DataFrame, weights: list[list[list[float]]]) -> list[DataFrame]:
    """Features after each layer, the input first; vertices without in-edges get zeros."""
    out = [features]
    for k, w in enumerate(weights):
        n = len(w[0])
        zeros = g.vertices.select("id", *[F.lit(0.0).alias(f"_{j}") for j in range(n)])
        out.append(cut(_summed(_pushed(out[-1], g.edges, w, k > 0).unionByName(zeros), n)))
    return out


def update(g: Graph, layers: list[DataFrame], weights: list[list[list[float]]], updates: DataFrame) -> tuple[Graph, list[DataFrame]]:
    """The updated graph and every layer's repaired features.

    A layer changes by what touched or changed sources send now, less what they sent before.
    """
    after = apply_updates(g, updates)
    touched = cut(effective(g, updates).select(F.col("src").alias("id")).distinct())
    out, changed = [layers[0]], None
    for k, w in enumerate(weights):
        n = len(w[0])
        movers = touched if changed is None else touched.unionByName(changed).distinct()
        now = _pushed(out[-1].join(movers, "id", "left_semi"), after.edges, w, k > 0)
        before = _pushed(layers[k].join(movers, "id", "left_semi"), g.edges, w, k > 0, -1)
        delta = cut(_summed(now.unionByName(before), n).withColumnRenamed("feature", "_d"))
        changed = delta.select("id")
        new = layers[k + 1].join(delta, "id", "left").select("id", F.when(F.col("_d").isNull(), F.col("feature")).otherwise(F.zip_with("feature", "_d", lambda a, b: a + b)).alias("feature"))
        out.append(cut(new))
    return after, out
