"""Summarised graphs: clusters, shortcuts from their entries, and the smaller skeleton.

``clusters`` is (id, cluster). An entry has an in-edge from outside its cluster, an exit an out-edge
to outside. A shortcut row (cluster, entry, target, factor|dist) says what a unit at the entry makes
of the target by edges inside the cluster alone. Iteration runs over shortcuts to exits and the edges
that leave clusters; values inside are filled in once at the end.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.functions.kernels import BFS, SSSP, SelectKernel, SumKernel
from deltaweave.operators.accessors import labelled
from deltaweave.operators.components import components
from deltaweave.operators.fixpoint import Rounds, select_fixpoint, sum_fixpoint
from deltaweave.operators.incremental import sent, update_select
from deltaweave.operators.updates import PAIR, updated
from deltaweave.session import cut, materialize
from deltaweave.sources.graph import EDGE, Graph


def _labels(clusters: DataFrame) -> DataFrame:
    return clusters.withColumnRenamed("cluster", "label")


def _named(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``edges`` with their ends' clusters, ``src_label`` and ``dst_label``; what has them already stays as it is."""
    return edges if "src_label" in edges.columns else labelled(edges, _labels(clusters))


def label_propagation(g: Graph, rounds: int = 5, max_size: int = 150) -> DataFrame:
    """A clusterer of our own: (id, cluster).

    Each vertex takes the most frequent label of its neighbours (ties: the least). A label with more
    than ``max_size`` members is split by ranges of ids; every vertex keeps a cluster.
    """
    both = g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "src").sortWithinPartitions("src").persist()  # read in every round
    state = g.vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = state.withColumnRenamed("id", "src").hint("merge").join(both, "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        state = cut(state.join(best, "id", "left").select("id", F.coalesce("b.label", "label").alias("label")))
    both.unpersist()
    sizes = state.groupBy("label").agg(F.count("*").alias("n"))
    parts = state.join(sizes, "label").withColumn("part", F.when(F.col("n") > max_size, F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("n") / max_size))).otherwise(F.lit(0)))
    return parts.select("id", F.min("id").over(Window.partitionBy("label", "part")).alias("cluster"))


def entry_exit(g: Graph, clusters: DataFrame) -> DataFrame:
    """(id, cluster, is_entry, is_exit) of clustered vertices."""
    over = _named(g.edges, clusters).where("not src_label <=> dst_label")
    ends = over.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    flags = ends.groupBy("e.id").agg(F.max("e.i").alias("i"), F.max("e.o").alias("o"))
    return clusters.join(flags, "id", "left").select("id", "cluster", (F.coalesce("i", F.lit(0)) == 1).alias("is_entry"), (F.coalesce("o", F.lit(0)) == 1).alias("is_exit"))


def cluster_benefit(g: Graph, clusters: DataFrame) -> DataFrame:
    """(cluster, n_members, n_inner, n_entry, n_exit, benefit): edges saved if shortcuts replace inner edges."""
    inner = _named(g.edges, clusters).where("src_label = dst_label").groupBy(F.col("src_label").alias("cluster")).agg(F.count("*").alias("n_inner"))
    ends = entry_exit(g, clusters).groupBy("cluster").agg(F.count("*").alias("n_members"), F.sum(F.col("is_entry").cast("long")).alias("n_entry"), F.sum(F.col("is_exit").cast("long")).alias("n_exit"))
    n = F.coalesce("n_inner", F.lit(0).cast("long"))
    return ends.join(inner, "cluster", "left").select("cluster", "n_members", n.alias("n_inner"), "n_entry", "n_exit", (n - F.col("n_entry") * F.col("n_exit")).alias("benefit"))


def admit(g: Graph, clusters: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """Clusters worth compressing."""
    good = cluster_benefit(g, clusters).where((F.col("benefit") > threshold) & (F.col("n_members") >= min_size)).select("cluster")
    return clusters.join(good, "cluster", "left_semi").select("id", "cluster")


def mirror_candidates(g: Graph, clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, id, side, n): outside vertices with over ``k`` edges into (``in``) or out of (``out``) a cluster."""
    over = labelled(g.edges, _labels(clusters)).where("not src_label <=> dst_label")
    sides = over.select(F.explode(F.array(F.struct(F.col("dst_label").alias("cluster"), F.col("src").alias("id"), F.lit("in").alias("side")), F.struct(F.col("src_label").alias("cluster"), F.col("dst").alias("id"), F.lit("out").alias("side")))).alias("s"))
    return sides.where("s.cluster is not null").groupBy("s.cluster", "s.id", "s.side").agg(F.count("*").alias("n")).where(F.col("n") > k)


def mirror_choice(g: Graph, clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, mirrors, benefit): the best of none, in, out and both.

    An in-mirror replaces its n edges into the cluster by one and becomes an entry; entries that only
    it fed are entries no more. Out-mirrors likewise with exits.
    """
    candidates = mirror_candidates(g, clusters, k)
    over = labelled(g.edges, _labels(clusters)).where("not src_label <=> dst_label")
    ins = over.where("dst_label is not null").select(F.col("dst_label").alias("cluster"), F.col("src").alias("out"), F.col("dst").alias("own"), F.lit("in").alias("side"))
    outs = over.where("src_label is not null").select(F.col("src_label").alias("cluster"), F.col("dst").alias("out"), F.col("src").alias("own"), F.lit("out").alias("side"))
    marked = ins.unionByName(outs).join(candidates.select("cluster", F.col("id").alias("out"), "side", F.lit(1).alias("m")), ["cluster", "out", "side"], "left")
    own = marked.groupBy("cluster", "side", "own").agg(F.min(F.coalesce("m", F.lit(0))).alias("freed"))
    freed = own.groupBy("cluster", "side").agg(F.sum("freed").cast("long").alias("freed"))
    made = candidates.groupBy("cluster", "side").agg(F.count("*").alias("made"), F.sum("n").alias("edges"))
    both = freed.join(made, ["cluster", "side"], "left").na.fill(0, ["made", "edges"])
    wide = both.groupBy("cluster").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0).cast("long")).alias(f"{s}_{c}") for s in ("in", "out") for c in ("freed", "made", "edges")])
    b = cluster_benefit(g, clusters).join(wide, "cluster", "left").na.fill(0)

    def benefit(i: int, o: int) -> str:
        entries, exits = f"(n_entry - {i} * in_freed + {i} * in_made)", f"(n_exit - {o} * out_freed + {o} * out_made)"
        return f"n_inner + {i} * (in_edges - in_made) + {o} * (out_edges - out_made) - {entries} * {exits}"

    choices = ", ".join(f"struct({benefit(i, o)} as benefit, {-k} as rank, '{name}' as mirrors)" for k, (i, o, name) in enumerate(((0, 0, "none"), (1, 0, "in"), (0, 1, "out"), (1, 1, "both"))))
    return b.select("cluster", F.expr(f"greatest({choices})").alias("c")).select("cluster", "c.mirrors", F.col("c.benefit").cast("long").alias("benefit"))


def node_types(g: Graph, clusters: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """(id, node_type) of all vertices; ``mirrors`` (id) are vertices with a mirror in another cluster."""
    ends = g.vertices.join(entry_exit(g, clusters), "id", "left")
    kind = F.when(F.col("cluster").isNull(), "Single").when(F.col("is_entry") & F.col("is_exit"), "BothOutIn").when(F.col("is_entry"), "OnlyIn").when(F.col("is_exit"), "OnlyOut").otherwise("Inner")
    if mirrors is None:
        return ends.select("id", kind.alias("node_type"))
    marked = ends.join(mirrors.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("_m") & (kind == "OnlyOut"), "OutMaster").when(F.col("_m") & (kind == "BothOutIn"), "BothOutInMaster").otherwise(kind).alias("node_type"))


def _split(edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges inside clusters, with ``cluster``, and the others."""
    e = _named(edges, clusters)
    rest = [c for c in edges.columns if c not in ("src_label", "dst_label")]
    return e.where("src_label = dst_label").select(*rest, F.col("src_label").alias("cluster")), e.where("not coalesce(src_label = dst_label, false)").select(*rest)


def _entries(g: Graph, clusters: DataFrame, source: int | None = None) -> DataFrame:
    """(cluster, entry); the source, if it has a cluster, counts as one."""
    over = _named(g.edges, clusters).where("dst_label is not null and not src_label <=> dst_label")
    found = over.select(F.col("dst_label").alias("cluster"), F.col("dst").alias("entry"))
    if source is not None:
        found = found.unionByName(clusters.where(F.col("id") == source).select("cluster", F.col("id").alias("entry")))
    return found.distinct()


def _exits(g: Graph, clusters: DataFrame) -> DataFrame:
    """(target)."""
    return _named(g.edges, clusters).where("src_label is not null and not src_label <=> dst_label").select(F.col("src").alias("target")).distinct()


def sum_shortcuts(g: Graph, clusters: DataFrame, kernel: SumKernel, how: Rounds, only: DataFrame | None = None) -> DataFrame:
    """(cluster, entry, target, factor); an entry's own row has a factor of 1 or more.

    Factors come from the whole graph's normalisers. ``only`` (cluster) restricts to some clusters.
    """
    inside, _ = _split(kernel.factors(g.edges), clusters)
    start = _entries(g, clusters).select("cluster", "entry", F.col("entry").alias("id"), F.lit(0.0).alias("value"), F.lit(1.0).alias("delta"))
    start = start if only is None else start.join(only, "cluster", "left_semi")
    done = sum_fixpoint(start, inside.select("src", "dst", "factor"), 1, how, ("cluster", "entry"))
    return done.select("cluster", "entry", F.col("id").alias("target"), (F.col("value") + F.col("delta")).alias("factor")).where("factor <> 0")


def select_shortcuts(g: Graph, clusters: DataFrame, kernel: SelectKernel, source: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """(cluster, entry, target, dist, parent) by paths inside the cluster."""
    inside, _ = _split(g.edges, clusters)
    start = _entries(g, clusters, source).select("cluster", "entry", F.col("entry").alias("id"), F.lit(kernel.origin).cast("long").alias("value"), F.lit(None).cast("long").alias("parent"))
    if only is not None:
        start, inside = (x.join(sent(only), "cluster", "left_semi") for x in (start, inside))
    done = select_fixpoint(start, inside.select("src", "dst", "weight"), kernel, ("cluster", "entry"))
    return done.select("cluster", "entry", F.col("id").alias("target"), F.col("value").alias("dist"), "parent")


def touched_clusters(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """Clusters of either end of effective updates; a changed normaliser touches the source's cluster."""
    ends = changes.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return clusters.join(ends, "id", "left_semi").select("cluster").distinct()


def refresh_shortcuts(old: DataFrame, g: Graph, clusters: DataFrame, changes: DataFrame, build) -> DataFrame:
    """Shortcuts on the updated graph ``g``: those of touched clusters are built anew, the others kept.

    ``build(g, clusters, only)`` is ``sum_shortcuts`` or ``select_shortcuts`` with its kernel. New
    entries lie in touched clusters, so they get shortcuts and vanished ones lose theirs.
    """
    touched = cut(touched_clusters(clusters, changes))
    return old.join(touched, "cluster", "left_anti").unionByName(build(g, clusters, touched))


def skeleton_edges(g: Graph, clusters: DataFrame, kernel: SelectKernel, source: int | None = None, shortcuts: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, kind): shortcuts from entries to exits and the edges outside clusters."""
    cuts = shortcuts if shortcuts is not None else select_shortcuts(g, clusters, kernel, source)
    jumps = cuts.where("entry <> target").join(_exits(g, clusters), "target", "left_semi").select(F.col("entry").alias("src"), F.col("target").alias("dst"), F.col("dist").alias("weight"), F.lit("shortcut").alias("kind"))
    _, outside = _split(g.edges, clusters)
    return jumps.unionByName(outside.select("src", "dst", "weight", F.lit("edge").alias("kind")))


def reverse_shortcuts(cuts: DataFrame) -> DataFrame:
    """(target, entry, ...) of every shortcut: which entries reach a vertex inside its cluster."""
    return cuts.select("target", "entry", *[c for c in cuts.columns if c not in ("target", "entry")])


def save_shortcuts(cuts: DataFrame, path: str) -> None:
    """Shortcuts as Parquet, so that a later run need not build them."""
    cuts.write.mode("overwrite").parquet(path)


def load_shortcuts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_skeleton(skeleton: DataFrame, path: str) -> None:
    """``src dst weight kind`` lines."""
    skeleton.select(F.concat_ws(" ", "src", "dst", "weight", "kind").alias("value")).write.mode("overwrite").text(path)


# --- mirrors -----------------------------------------------------------------------------------------


def chosen_mirrors(g: Graph, clusters: DataFrame, k: int, every: bool = False) -> DataFrame:
    """(cluster, id, side, mirror): the mirrors of ``mirror_choice``, or ``every`` candidate, with an id of their own below 0.

    A mirror's id comes from its vertex, cluster and side, so it is the same in every run.
    """
    width = max(x or 0 for r in (g.vertices.agg(F.max("id")), clusters.agg(F.max("cluster"))) for x in r.first()) + 1
    if width > 1_500_000_000:
        raise ValueError("ids are too large to number mirrors")
    found = mirror_candidates(g, clusters, k)
    if not every:
        choice = mirror_choice(g, clusters, k).where("mirrors <> 'none'").select("cluster", "mirrors")
        found = found.join(choice, "cluster").where("mirrors in (side, 'both')")
    return found.select("cluster", "id", "side", (-1 - (F.col("id") * width + F.col("cluster")) * 2 - (F.col("side") == "out").cast("long")).alias("mirror"))


def with_mirrors(edges: DataFrame, clusters: DataFrame, mirrors: DataFrame, value: str, unit) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, value, src_label, dst_label) and clusters in which mirrors take part.

    The edges of a vertex into a cluster where it has an in-mirror start at that mirror, inside the
    cluster, and one edge of value ``unit`` leads from the vertex to it; out-mirrors likewise at the end.
    """
    n = mirrors.count()
    into = sent(mirrors.where("side = 'in'").select(F.col("id").alias("src"), F.col("cluster").alias("dst_label"), F.col("mirror").alias("_in")), n)
    out = sent(mirrors.where("side = 'out'").select(F.col("id").alias("dst"), F.col("cluster").alias("src_label"), F.col("mirror").alias("_out")), n)
    e = _named(edges, clusters).join(into, ["src", "dst_label"], "left").join(out, ["dst", "src_label"], "left")
    inwards, outwards = F.col("_in").isNotNull(), F.col("_in").isNull() & F.col("_out").isNotNull()
    a, b = F.when(inwards, F.col("dst_label")).otherwise(F.col("src_label")), F.when(outwards, F.col("src_label")).otherwise(F.col("dst_label"))
    moved = e.select(F.coalesce("_in", "src").alias("src"), F.when(outwards, F.col("_out")).otherwise(F.col("dst")).alias("dst"), value, a.alias("src_label"), b.alias("dst_label"))
    more = clusters.select("id", "cluster").unionByName(mirrors.select(F.col("mirror").alias("id"), "cluster"))
    sides = F.when(F.col("side") == "in", F.struct(F.col("id").alias("src"), F.col("mirror").alias("dst"))).otherwise(F.struct(F.col("mirror").alias("src"), F.col("id").alias("dst")))
    sync = mirrors.select(sides.alias("s")).select("s.src", "s.dst", F.lit(unit).cast(dict(edges.dtypes)[value]).alias(value))
    return moved.unionByName(labelled(sync, _labels(more))), more


def _mirrored(g: Graph, clusters: DataFrame, kernel: SelectKernel, k: int, every: bool) -> tuple[Graph, DataFrame]:
    mirrors = cut(chosen_mirrors(g, clusters, k, every))
    edges, clusters = with_mirrors(g.edges, clusters, mirrors, "weight", 0 if kernel.least else kernel.origin)
    vertices = g.vertices.select("id").unionByName(mirrors.select(F.col("mirror").alias("id")))
    return Graph(cut(vertices), cut(edges), g.directed), cut(clusters)


# --- select kernels on the skeleton ------------------------------------------------------------------


class SelectSkeleton:
    """A select kernel's result by iteration on the skeleton, kept up to date batch by batch.

    Shortcuts are built once; a batch builds those of touched clusters anew. The skeleton's own edges
    before and after are compared, and the values on it are repaired as on any graph.
    """

    def __init__(self, g: Graph, clusters: DataFrame, kernel: SelectKernel, source: int, shortcuts: DataFrame | None = None) -> None:
        if kernel.own:
            raise ValueError("kernels that start everywhere have no single source; see skeleton_components")
        self.unit = kernel is BFS  # hops are paths of unit weights; a shortcut counts for several
        self.kernel, self.source, self.clusters = SSSP if self.unit else kernel, source, clusters
        edges = self._weighted(_named(g.edges, clusters)).select(*EDGE, "src_label", "dst_label")
        self.graph = replace(g, edges=materialize(edges, "edges"))  # with labels, so that they are joined once
        self.cuts = materialize(shortcuts if shortcuts is not None else self._build(self.graph, clusters, None), "shortcuts")
        self.edges = materialize(self._best(self._skeleton()), "skeleton")
        self.outer = select_fixpoint(self.kernel.start(self.graph, source), self.edges, self.kernel, ids=g.vertices)

    def _weighted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("weight", F.lit(1).cast("long")) if self.unit else rows

    def _build(self, g: Graph, clusters: DataFrame, only: DataFrame | None) -> DataFrame:
        return select_shortcuts(g, clusters, self.kernel, self.source, only)

    def _skeleton(self) -> DataFrame:
        return skeleton_edges(self.graph, self.clusters, self.kernel, self.source, self.cuts)

    def _best(self, edges: DataFrame) -> DataFrame:
        return edges.groupBy("src", "dst").agg((F.min("weight") if self.kernel.least else F.max("weight")).alias("weight"))

    def update(self, updates: DataFrame) -> None:
        """Only pairs of the batch and of the touched clusters' shortcuts can change on the skeleton."""
        g = self.graph
        _, changes = updated(replace(g, edges=g.edges.select(*EDGE)), self._weighted(updates))
        gone = sent(cut(changes.where("op = 'd'").select(*PAIR).distinct()))
        added = labelled(changes.where("op = 'a'").select(*EDGE), _labels(self.clusters))
        self.graph = replace(g, edges=materialize(g.edges.join(gone, PAIR, "left_anti").unionByName(added), "edges"))
        touched = cut(touched_clusters(self.clusters, changes))
        before, pairs = self.cuts, changes.select(*PAIR)
        self.cuts = materialize(before.join(touched, "cluster", "left_anti").unionByName(self._build(self.graph, self.clusters, touched)), "shortcuts")
        for cuts in (before, self.cuts):
            pairs = pairs.unionByName(cuts.where("entry <> target").join(touched, "cluster", "left_semi").select(F.col("entry").alias("src"), F.col("target").alias("dst")))
        pairs = sent(cut(pairs.distinct()))
        was = self.edges.join(pairs, PAIR, "left_semi").withColumnRenamed("weight", "_was")
        now = cut(self._best(self._skeleton().join(pairs, PAIR, "left_semi")))
        old, self.edges = self.edges, materialize(self.edges.join(pairs, PAIR, "left_anti").unionByName(now), "skeleton")
        moved = now.join(was, PAIR, "full_outer").where("not weight <=> _was")
        batch = moved.select(F.when(F.col("weight").isNull(), "d").otherwise("a").alias("op"), *EDGE)
        _, self.outer = update_select(Graph(g.vertices, old), self.outer, batch, self.kernel, self.source)

    def values(self) -> DataFrame:
        """(id, value) of reached vertices: the skeleton's, and the interiors' from it."""
        inner = self.outer.select(F.col("id").alias("entry"), F.col("value").alias("_v")).join(self.cuts, "entry")
        filled = inner.select(F.col("target").alias("id"), self.kernel.extend(F.col("_v"), F.col("dist")).alias("value"))
        best = F.min("value") if self.kernel.least else F.max("value")
        return self.outer.select("id", "value").unionByName(filled).groupBy("id").agg(best.alias("value"))


def skeleton_select(g: Graph, clusters: DataFrame, kernel: SelectKernel, source: int | None, mirror_k: int | None = None, every: bool = False) -> DataFrame:
    """(id, value) as the plain run gives them: iterate on the skeleton, then fill in the interiors. ``mirror_k`` allows mirrors."""
    if mirror_k is None:
        return SelectSkeleton(g, clusters, kernel, source).values()
    if kernel is BFS:
        g, kernel = replace(g, edges=g.edges.withColumn("weight", F.lit(1).cast("long"))), SSSP
    more, members = _mirrored(g, clusters, kernel, mirror_k, every)
    return SelectSkeleton(more, members, kernel, source).values().where("id >= 0")


def skeleton_components(g: Graph, clusters: DataFrame) -> DataFrame:
    """(id, value): least id of each component. Shortcuts join what is connected inside a cluster; the skeleton is the edges between."""
    inside, outside = _split(g.edges, clusters)
    ends = [F.col("src").alias("a"), F.col("dst").alias("b")]
    local = cut(components(inside.select(*ends)).select(F.col("node").alias("id"), "root"))
    a, b = (local.select(F.col("id").alias(x), F.col("root").alias(f"_{x}")) for x in ("a", "b"))
    between = outside.select(*ends).join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    whole = components(between).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    found = g.vertices.join(local, "id", "left").withColumn("_l", F.coalesce("root", "id"))
    return found.join(whole, F.col("_l") == F.col("_n"), "left").select("id", F.coalesce("_r", "_l").alias("value"))


# --- sum kernels on the skeleton ---------------------------------------------------------------------


class SumSkeleton:
    """A sum kernel's result by iteration on the skeleton, kept up to date batch by batch.

    Initial deltas converge inside clusters first and go out once. Then a round takes what entries
    have received over shortcuts to exits and from there over outside edges; entries only total what
    they receive. At last the totals times the shortcuts give every value. After a batch the inside
    phase and the shortcuts of touched clusters are computed anew; totals take back what they sent over
    the skeleton's old edges and send it over the new ones.
    """

    def __init__(self, g: Graph, clusters: DataFrame, kernel: SumKernel, how: Rounds, mirror_k: int | None = None, every: bool = False) -> None:
        self.kernel, self.how, self.graph, self.n = kernel, how, g, g.vertices.count()
        self.given, self.mirrors = clusters, cut(chosen_mirrors(g, clusters, mirror_k, every)) if mirror_k is not None else None
        self._load(g)
        self.first = cut(self._first(None))
        self.cuts = cut(self._shortcuts(None))
        self.hops, self.sent = materialize(self._hops(), "hops"), cut(self._sent())
        self.totals = sum_fixpoint(self.sent.select("id", F.lit(0.0).alias("value"), "delta"), self.hops, self.n, how)

    def _load(self, g: Graph) -> None:
        factors = self.kernel.factors(g.edges).select("src", "dst", "factor")
        self.vertices, self.clusters = g.vertices, self.given
        if self.mirrors is not None:
            factors, self.clusters = with_mirrors(factors, self.given, self.mirrors, "factor", 1.0)
            self.vertices = g.vertices.select("id").unionByName(self.mirrors.select(F.col("mirror").alias("id")))
        factors = materialize(_named(factors, self.clusters), "factors")
        inside, outside = _split(factors, self.clusters)
        self.inside, self.outside = inside.select("src", "dst", "factor"), outside.select("src", "dst", "factor")
        self.all = Graph(self.vertices, factors.withColumnRenamed("factor", "weight"))

    def _first(self, only: DataFrame | None) -> DataFrame:
        start = self.kernel.start(self.graph, self.n)
        start = start if only is None else start.join(self.given.join(only, "cluster", "left_semi").select("id"), "id", "left_semi")
        done = sum_fixpoint(start, self.inside, self.n, self.how, ids=self.vertices)
        return done.select("id", (F.col("value") + F.col("delta")).alias("value")).where("value <> 0")

    def _shortcuts(self, only: DataFrame | None) -> DataFrame:
        start = _entries(self.all, self.clusters).select("cluster", "entry", F.col("entry").alias("id"), F.lit(0.0).alias("value"), F.lit(1.0).alias("delta"))
        start = start if only is None else start.join(only, "cluster", "left_semi")
        done = sum_fixpoint(start, self.inside, 1, self.how, ("cluster", "entry"))
        return done.select("cluster", "entry", F.col("id").alias("target"), (F.col("value") + F.col("delta")).alias("factor")).where("factor <> 0")

    def _all_cuts(self) -> DataFrame:
        own = self.vertices.join(self.clusters, "id", "left_anti").select(F.lit(None).cast("long").alias("cluster"), F.col("id").alias("entry"), F.col("id").alias("target"), F.lit(1.0).alias("factor"))
        return self.cuts.unionByName(own)

    def _hops(self) -> DataFrame:
        jumps = self._all_cuts().select(F.col("entry").alias("src"), F.col("target").alias("mid"), F.col("factor").alias("f1"))
        return jumps.join(self.outside.select(F.col("src").alias("mid"), "dst", "factor"), "mid").groupBy("src", "dst").agg(F.sum(F.col("f1") * F.col("factor")).alias("factor"))

    def _sent(self) -> DataFrame:
        return self.first.join(self.outside, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("factor")).alias("delta"))

    def update(self, updates: DataFrame) -> None:
        after, changes = updated(self.graph, updates)
        touched = touched_clusters(self.given, changes)
        if self.mirrors is not None:  # a changed normaliser reaches the clusters where its vertex has an in-mirror
            far = self.mirrors.where("side = 'in'").join(changes.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("cluster")
            touched = touched.unionByName(far).distinct()
        touched = cut(touched)
        self.graph = replace(after, edges=materialize(after.edges, "edges"))
        self._load(self.graph)
        redone = self.clusters.join(touched, "cluster", "left_semi").select("id")
        self.first = cut(self.first.join(redone, "id", "left_anti").unionByName(self._first(touched)))
        self.cuts = cut(self.cuts.join(touched, "cluster", "left_anti").unionByName(self._shortcuts(touched)))
        old_hops, old_sent = self.hops, self.sent
        self.hops, self.sent = materialize(self._hops(), "hops"), cut(self._sent())
        sender = self.totals.select(F.col("id").alias("src"), "value")
        moved = self.hops.unionByName(old_hops.withColumn("factor", -F.col("factor"))).groupBy("src", "dst").agg(F.sum("factor").alias("factor")).where("factor <> 0")
        again = moved.join(sender, "src").select(F.col("dst").alias("id"), (F.col("value") * F.col("factor")).alias("delta"))
        deltas = again.unionByName(self.sent).unionByName(old_sent.withColumn("delta", -F.col("delta"))).withColumn("value", F.lit(0.0))
        state = self.totals.select("id", "value", "delta").unionByName(deltas.select("id", "value", "delta")).groupBy("id").agg(F.sum("value").alias("value"), F.sum("delta").alias("delta"))
        self.totals = sum_fixpoint(cut(state), self.hops, self.n, self.how)

    def values(self) -> DataFrame:
        """(id, value) of all vertices, 0 where nothing arrives."""
        totals = self.totals.select(F.col("id").alias("entry"), (F.col("value") + F.col("delta")).alias("total"))
        filled = totals.join(self._all_cuts(), "entry").select(F.col("target").alias("id"), (F.col("total") * F.col("factor")).alias("value"))
        parts = self.first.unionByName(filled).unionByName(self.graph.vertices.select("id", F.lit(0.0).alias("value")))
        return cut(parts.where("id >= 0").groupBy("id").agg(F.sum("value").alias("value")))


def skeleton_sum(g: Graph, clusters: DataFrame, kernel: SumKernel, how: Rounds, mirror_k: int | None = None, every: bool = False) -> DataFrame:
    """(id, value) as the plain run converges to. ``mirror_k`` allows mirrors."""
    return SumSkeleton(g, clusters, kernel, how, mirror_k, every).values()


def finish_sum(g: Graph, values: DataFrame, kernel: SumKernel, how: Rounds) -> DataFrame:
    """(id, value, delta): plain iteration from ``values`` (id, value) until the threshold of ``how``.

    The pending deltas are what a round would change: what a vertex starts with and receives, less what it has.
    """
    n = g.vertices.count()
    factors = kernel.factors(g.edges)
    sent = values.join(factors, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(0.0).alias("value"), (F.col("value") * F.col("factor")).alias("delta"))
    own = values.select("id", "value", (-F.col("value")).alias("delta"))
    state = kernel.start(g, n).unionByName(own).unionByName(sent).groupBy("id").agg(F.sum("value").alias("value"), F.sum("delta").alias("delta"))
    return sum_fixpoint(cut(state), factors, n, how, ids=g.vertices, counted=g.edges)


def compression_stats(g: Graph, clusters: DataFrame, bin_width: int = 500) -> DataFrame:
    """(bin, n_clusters, n_members, n_inner, n_entry, n_exit): totals by the clusters' size."""
    b = cluster_benefit(g, clusters).withColumn("bin", F.expr(f"n_members div {bin_width}"))
    return b.groupBy("bin").agg(F.count("*").alias("n_clusters"), *[F.sum(c).alias(c) for c in ("n_members", "n_inner", "n_entry", "n_exit")])
