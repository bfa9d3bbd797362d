"""One entry for all applications: a graph from files, a batch of updates from a file, a result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.functions import BFS, CC, SSSP, SSWP, SelectKernel, pagerank_kernel, personalised_pagerank_kernel, php_kernel
from deltaweave.operators import gcn
from deltaweave.operators.accessors import labelled
from deltaweave.operators.fixpoint import Rounds, dense, run_select, run_sum
from deltaweave.operators.incremental import update_select, update_sum
from deltaweave.operators.summarize import SelectSkeleton, SumSkeleton, admit, finish_sum, label_propagation, skeleton_components
from deltaweave.operators.updates import apply_updates, validate
from deltaweave.plans import algorithms
from deltaweave.session import cut, materialize
from deltaweave.sources.graph import Graph, kept
from deltaweave.sources.text import read_clusters, read_graph, read_updates, write_result

SELECT = {"bfs": BFS, "sssp": SSSP, "sswp": SSWP, "cc": CC, "wcc": CC}
SUM = ("pagerank", "ppr", "php")
VECTOR = ("tornado_pagerank", "tornado_php", "gcn")


@dataclass(frozen=True)
class Options:
    """What a run can be told.

    ``incremental`` repairs the result after the updates, otherwise the updated graph is run anew.
    ``compress`` iterates on the skeleton: of the clusters in ``cluster_file``, else of clusters found by
    label propagation, those of ``min_node_num`` to ``max_node_num`` members whose benefit is over
    ``compress_threshold``; ``mirror_k`` allows mirrors of vertices with more edges than that into a cluster.
    """

    source: int = 0
    damping: float = 0.85
    directed: bool = True
    weight_type: str = "long"
    termcheck_threshold: float = 1e-6
    max_round: int = 1000
    portion: float = 1.0
    incremental: bool = True
    compress: bool = False
    cluster_file: str | None = None
    min_node_num: int = 2
    max_node_num: int = 1000
    compress_threshold: float = 0.0
    mirror_k: int | None = None
    gcn_layers: int = 2

    @property
    def rounds(self) -> Rounds:
        return Rounds(threshold=self.termcheck_threshold, most=self.max_round, portion=self.portion)


def run(spark: SparkSession, application: str, efile: str, vfile: str | None = None, efile_update: str | None = None, out: str | None = None, options: Options | None = None) -> DataFrame:
    """(id, value) of an application on the graph of ``efile`` and ``vfile`` after the updates of ``efile_update``; written to ``out`` if given.

    Applications are the keys of SELECT, and SUM and VECTOR. An unknown one raises.
    """
    o = options or Options()
    if application not in (*SELECT, *SUM, *VECTOR):
        raise ValueError(f"unknown application {application!r}")
    g = read_graph(spark, efile, vfile, o.directed and application not in ("cc", "wcc"), o.weight_type)
    g = kept(g, ends=vfile is None)
    updates = validate(g, cut(read_updates(spark, efile_update, o.weight_type))) if efile_update else None
    if application in SELECT:
        state = _select(g, SELECT[application], updates, o)
    elif application in SUM:
        state = _sum(g, _kernel(application, o), updates, o)
    else:
        state = _vector(Graph(g.vertices, cut(apply_updates(g, updates).edges), g.directed) if updates is not None else g, application, o)
    if out is not None:
        kernel = SELECT.get(application)
        write_result(state, out, unreachable=str(kernel.unreachable) if kernel is not None and kernel.unreachable is not None else None)
    return state


def _kernel(application: str, o: Options):
    return {"pagerank": lambda: pagerank_kernel(o.damping), "ppr": lambda: personalised_pagerank_kernel(o.source, o.damping), "php": lambda: php_kernel(o.source, o.damping)}[application]()


def _clusters(g: Graph, o: Options) -> DataFrame:
    found = read_clusters(g.vertices.sparkSession, o.cluster_file, o.min_node_num) if o.cluster_file else label_propagation(g, max_size=o.max_node_num)
    found = materialize(found.select("id", "cluster"), "clusters")
    named = replace(g, edges=materialize(labelled(g.edges, found.withColumnRenamed("cluster", "label")), "edges"))
    return cut(admit(named, found, o.compress_threshold, o.min_node_num))


def _select(g: Graph, kernel: SelectKernel, updates: DataFrame | None, o: Options) -> DataFrame:
    source = None if kernel.own else o.source
    if updates is not None and not o.incremental:
        g, updates = Graph(g.vertices, cut(apply_updates(g, updates).edges), g.directed), None
    if o.compress and kernel.own:
        after = g if updates is None else Graph(g.vertices, cut(apply_updates(g, updates).edges), g.directed)
        return skeleton_components(after, _clusters(after, o))
    if o.compress:
        skeleton = SelectSkeleton(g, _clusters(g, o), kernel, source)
        if updates is not None:
            skeleton.update(updates)
        return dense(g, skeleton.values(), kernel)
    if kernel.own and updates is None:
        return algorithms.connected_components(g)
    state = run_select(g, kernel, source)
    if updates is not None:
        g, state = update_select(g, state, updates, kernel, source)
    return dense(g, state.select("id", "value"), kernel)


def _sum(g: Graph, kernel, updates: DataFrame | None, o: Options) -> DataFrame:
    if updates is not None and not o.incremental:
        g, updates = Graph(g.vertices, cut(apply_updates(g, updates).edges), g.directed), None
    if o.compress:
        skeleton = SumSkeleton(g, _clusters(g, o), kernel, o.rounds, o.mirror_k)
        if updates is not None:
            skeleton.update(updates)
        return finish_sum(skeleton.graph, skeleton.values(), kernel, o.rounds).select("id", "value")
    state = run_sum(g, kernel, o.rounds)
    if updates is not None:
        g, state = update_sum(g, state, updates, kernel, o.rounds)
    return state.select("id", "value")


def _vector(g: Graph, application: str, o: Options) -> DataFrame:
    if application == "tornado_pagerank":
        return algorithms.pagerank_with_sinks(g, o.max_round, o.damping, o.termcheck_threshold)
    if application == "tornado_php":
        return algorithms.php_fixed_rounds(g, o.source, o.max_round, o.damping, o.termcheck_threshold)
    dims = gcn.default_dims(o.gcn_layers)
    weights = [gcn.default_weights(a, b) for a, b in zip(dims, dims[1:])]
    last = gcn.forward(g, gcn.initial_features(g, dims[0]), weights)[-1]
    return last.select("id", F.concat_ws(",", F.transform("feature", lambda x: x.cast("string"))).alias("value"))
