"""The toy graph and other small graphs with known answers."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from deltaweave import catalog
from deltaweave.functions import BFS, CC, SSSP, SSWP, pagerank_kernel, php_kernel
from deltaweave.operators import accessors, datagen, fixpoint, gcn, incremental, summarize, updates
from deltaweave.operators.fixpoint import Rounds, dense, run_select, run_sum
from deltaweave.plans import algorithms
from deltaweave.sources import Graph, dense_rank_in_order, lead_in_order

# A toy graph, one "src dst" pair after the other.
TOY = """0 1, 0 2, 0 3, 1 4, 1 5, 1 2, 2 5, 2 3, 3 2, 3 6, 4 7, 5 7, 5 8, 5 9, 6 2, 6 8, 7 4, 8 9, 9 11, 10 9, 11 14, 14 12, 14 13, 14 15, 12 10, 12 13, 13 15, 9 16,
16 17, 16 18, 16 19, 17 20, 17 21, 18 21, 21 18, 19 21, 19 22, 20 21, 21 23, 22 23, 22 24, 23 24, 24 25, 24 26, 25 27, 26 25, 26 27, 27 25, 28 27, 29 9, 30 16, 31 23"""


def graph(spark, edges, directed=True, n=None):
    rows = [(*e, 1) if len(e) == 2 else e for e in edges]
    v = spark.range(n) if n else None
    return Graph.of(spark.createDataFrame(rows, "src long, dst long, weight long"), v, directed)


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 3 else r for r in rows], "op string, src long, dst long, weight long")


def values(df):
    return {r["id"]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def toy(spark):
    return graph(spark, [tuple(map(int, e.split())) for e in TOY.replace("\n", " ").split(",")]).cached()


def test_toy_hops(toy):
    hops = values(algorithms.bfs(toy, 0))
    assert {k: hops[k] for k in (4, 9, 16, 14, 10, 23, 25, 27)} == {4: 2, 9: 3, 16: 4, 14: 5, 10: 7, 23: 7, 25: 8, 27: 9}
    assert [k for k, v in sorted(hops.items()) if v is None] == [28, 29, 30, 31]
    assert values(algorithms.sssp(toy, 0)) == hops
    assert values(algorithms.bfs(toy, 0, sentinel=True))[28] == 2147483647


def test_toy_skeleton(toy):
    clusters = toy.vertices.select("id", F.expr("id div 6").alias("cluster"))
    assert values(dense(toy, summarize.skeleton_select(toy, clusters, BFS, 0), BFS)) == values(algorithms.bfs(toy, 0))
    how = Rounds(threshold=1e-8, most=300)
    plain, short = values(run_sum(toy, pagerank_kernel(0.4), how)), values(summarize.skeleton_sum(toy, clusters, pagerank_kernel(0.4), how))
    assert plain.keys() == short.keys() and all(abs(plain[k] - short[k]) < 1e-7 for k in plain)


def test_accessors(toy, spark):
    assert accessors.counts(toy).first() == (32, 52)
    assert {r["id"] for r in accessors.with_parent(toy).collect()} == set(range(1, 28))
    assert 15 not in {r["id"] for r in accessors.with_child(toy).collect()}
    multi = graph(spark, [(0, 1), (0, 1), (0, 2)])
    assert {r["id"]: r["degree"] for r in accessors.out_degree(multi).collect()} == {0: 3, 1: 0, 2: 0}
    assert updates.apply_updates(multi, batch(spark, ("d", 0, 1))).edges.count() == 1
    of = spark.createDataFrame([(0,)], "id long")
    assert sorted(r["neighbour"] for r in accessors.neighbours(multi, of).collect()) == [1, 1, 2]


DIAMOND = [(0, 1, 1), (0, 2, 4), (1, 2, 2), (2, 3, 1)]


def test_diamond(spark):
    g = graph(spark, DIAMOND)
    assert values(algorithms.sssp(g, 0)) == {0: 0, 1: 1, 2: 3, 3: 4}
    assert values(algorithms.bfs(g, 0)) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert {k: v for k, v in values(algorithms.sswp(g, 0)).items() if k} == {1: 1, 2: 4, 3: 1}


def _updated(spark, edges, rows, kernel=SSSP, source=0, directed=True):
    g = graph(spark, edges, directed)
    after, state = incremental.update_select(g, run_select(g, kernel, source), batch(spark, *rows), kernel, source)
    return values(dense(after, state, kernel))


def test_repairs(spark):
    assert _updated(spark, DIAMOND, [("d", 1, 2)]) == {0: 0, 1: 1, 2: 4, 3: 5}
    assert _updated(spark, DIAMOND, [("a", 0, 1, 9)]) == {0: 0, 1: 9, 2: 4, 3: 5}
    assert _updated(spark, [(0, 1, 1), (1, 2, 1), (2, 1, 1)], [("d", 0, 1)]) == {0: 0, 1: None, 2: None}
    g = graph(spark, DIAMOND)
    state = run_select(g, SSSP, 0)
    removed = batch(spark, ("d", 1, 2))
    assert {r["id"] for r in incremental.reset_set(state, removed).collect()} == {2, 3}
    assert incremental.reset_statistics(state, incremental.reset_set(state, removed)).first() == (2, 0.5)


def test_zero_weights_make_no_parent_cycle(spark):
    state = {r["id"]: (r["value"], r["parent"]) for r in run_select(graph(spark, [(0, 1, 0), (1, 2, 0), (2, 1, 0)]), SSSP, 0).collect()}
    assert state == {0: (0, None), 1: (0, 0), 2: (0, 1)}


def test_sinks(spark):
    g = graph(spark, [(0, 1), (1, 2)])
    assert sum(values(algorithms.pagerank(g, Rounds(60))).values()) < 0.6
    assert abs(sum(values(algorithms.pagerank_with_sinks(g, 12, damping=0.3)).values()) - 1) < 1e-4


def test_php(spark):
    g = graph(spark, [(0, 1, 1), (0, 2, 3), (1, 0, 5), (1, 2, 1)])
    factors = {(r["src"], r["dst"]): r["factor"] for r in php_kernel(0).factors(g.edges).collect()}
    assert factors == {(0, 1): 0.8 * 1 / 4, (0, 2): 0.8 * 3 / 4, (1, 2): 0.8}
    assert values(algorithms.php_fixed_rounds(g, 0, 10)) == pytest.approx({0: 1.0, 1: 0.2, 2: 0.76})


def test_updates(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 5)])
    assert updates.effective(g, batch(spark, ("d", 0, 1), ("a", 0, 1, 1))).isEmpty()
    first = spark.createDataFrame([("a", 2, 0, 9, 0), ("a", 2, 0, 3, 1)], "op string, src long, dst long, weight long, line long")
    assert updates.apply_updates(g, first).edges.where("src = 2").first()["weight"] == 9
    with pytest.raises(ValueError):
        updates.validate(g, batch(spark, ("a", 0, 77, 1)))
    u = batch(spark, ("d", 0, 1), ("a", 1, 2, 7), ("a", 2, 0, 4))
    after = updates.apply_updates(g, u)
    back = updates.apply_updates(after, updates.inverse(g, u)).edges
    assert sorted(back.collect()) == sorted(g.edges.collect())


def _random(seed, n=40, m=140):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)): rng.randrange(0, 9) for _ in range(m)}
    edges = [(a, b, w) for (a, b), w in sorted(edges.items())]
    rows = [("d", a, b) for a, b, _ in rng.sample(edges, len(edges) // 5)] + [("a", a, b, w + 5) for a, b, w in rng.sample(edges, len(edges) // 12)] + [("a", rng.randrange(n), rng.randrange(n), rng.randrange(9)) for _ in range(15)]
    return n, edges, list({(r[1], r[2]): r for r in rows}.values())


def _dijkstra(n, edges, source):
    out, heap, dist = {}, [(0, source)], {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while heap:
        d, a = heapq.heappop(heap)
        if a not in dist:
            dist[a] = d
            for b, w in out.get(a, ()):
                heapq.heappush(heap, (d + w, b))
    return {k: dist.get(k) for k in range(n)}


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    n, edges, rows = _random(seed)
    g = graph(spark, edges, n=n)
    assert values(algorithms.sssp(g, 0)) == _dijkstra(n, edges, 0)
    b = batch(spark, *rows)
    for kernel in (SSSP, SSWP):
        after, state = incremental.update_select(g, run_select(g, kernel, 0), b, kernel, 0)
        assert values(dense(after, state, kernel)) == values(dense(after, run_select(after, kernel, 0), kernel))
    assert values(dense(after, run_select(after, SSSP, 0), SSSP)) == _dijkstra(n, [tuple(r) for r in after.edges.collect()], 0)
    clusters = g.vertices.select("id", F.expr("id div 8").alias("cluster"))
    assert values(dense(g, summarize.skeleton_select(g, clusters, SSSP, 0), SSSP)) == _dijkstra(n, edges, 0)


def test_incremental_sum(spark):
    n, edges, rows = _random(3)
    g, b, how = graph(spark, edges, n=n), batch(spark, *rows), Rounds(threshold=1e-8, most=200)
    for kernel in (pagerank_kernel(0.4), php_kernel(0, 0.4)):
        after, state = incremental.update_sum(g, run_sum(g, kernel, how), b, kernel, how)
        assert values(state) == pytest.approx(values(run_sum(after, kernel, how)), abs=1e-6)


def test_incremental_components(spark):
    n, edges, rows = _random(4, n=30, m=25)
    g = graph(spark, edges, directed=False, n=n)
    b = batch(spark, *rows)
    after, state = incremental.update_select(g, run_select(g, CC), b, CC)
    assert values(state) == values(run_select(after, CC))
    with pytest.raises(ValueError):
        algorithms.connected_components(graph(spark, edges))


def test_refreshed_shortcuts(spark):
    n, edges, rows = _random(5)
    g, b = graph(spark, edges, n=n), batch(spark, *rows)
    clusters = g.vertices.select("id", F.expr("id div 8").alias("cluster"))
    after = updates.apply_updates(g, b)

    def build(graph_, clusters_, only):
        return summarize.select_shortcuts(graph_, clusters_, SSSP, only=only)

    fresh = summarize.refresh_shortcuts(build(g, clusters, None), after, clusters, updates.effective(g, b), build)
    keep = ["cluster", "entry", "target", "dist"]
    assert sorted(fresh.select(keep).collect()) == sorted(build(after, clusters, None).select(keep).collect())


def test_gcn(spark):
    n, edges, rows = _random(6)
    g, b = graph(spark, edges, n=n), batch(spark, *rows)
    dims = [4, 3, 2]
    weights = [gcn.default_weights(x, y) for x, y in zip(dims, dims[1:])]
    layers = gcn.forward(g, gcn.initial_features(g, 4), weights)
    after, repaired = gcn.update(g, layers, weights, b)
    again = gcn.forward(after, gcn.initial_features(g, 4), weights)
    for a, c in zip(repaired, again):
        a, c = ({r["id"]: list(r["feature"]) for r in x.collect()} for x in (a, c))
        assert a.keys() == c.keys() and all(a[k] == pytest.approx(c[k]) for k in a)
    assert gcn.default_dims(2) == [64, 32, 16]


def test_order_without_one_task(spark):
    rng = random.Random(7)
    ks = sorted(rng.sample(range(5000), 200))
    df = spark.createDataFrame([(k, k * 3) for k in ks], "k long, v long")
    nexts = {r["k"]: r["n"] for r in lead_in_order(df, "k", "v", "n", width=7).collect()}
    assert nexts == {a: b * 3 if b is not None else None for a, b in zip(ks, [*ks[1:], None])}
    ranks = {r["id"]: r["new_id"] for r in dense_rank_in_order(df.select(F.col("k").alias("id")), width=7).collect()}
    assert ranks == {k: i for i, k in enumerate(ks)}


def test_data_sets(spark):
    e = spark.createDataFrame([(a, (a * 7 + j) % 50, 1 + j) for a in range(50) for j in range(6)], "src long, dst long, weight long")
    base, batch_, after = datagen.split_graphs(datagen.split_updates(e, 0.3))
    assert batch_.count() > 0
    assert sorted(updates.apply_updates(Graph.of(base), batch_).edges.collect()) == sorted(after.collect())
    assert datagen.close_sinks(spark.createDataFrame([(0, 1, 1)], "src long, dst long, weight long")).count() == 2
    labels = summarize.label_propagation(Graph.of(e), 3, 10)
    assert labels.count() == 50 and labels.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 50
    same = e.select(F.col("src").alias("id"), F.col("weight").cast("double").alias("value")).dropDuplicates(["id"])
    assert datagen.result_diff(same, same).first()[:5] == (50, 0, 0, 0.0, 0)


def test_portion_reaches_the_same_fixpoint(toy):
    a, b = (values(run_sum(toy, pagerank_kernel(0.3), Rounds(threshold=1e-6, most=500, portion=p))) for p in (1.0, 0.5))
    assert a == pytest.approx(b, abs=1e-5)


def _rounds(monkeypatch, run):
    """The values of ``run`` and how many rounds it makes."""
    made, plain = [], fixpoint.sum_round
    monkeypatch.setattr(fixpoint, "sum_round", lambda *a, **b: made.append(1) or plain(*a, **b))
    return values(run()), len(made)


def test_hastened_runs_reach_the_same_fixpoint_in_fewer_rounds(spark, monkeypatch):
    edges = [(a, (a * 7 + j * j + 3) % 60, 1 + j) for a in range(60) for j in range(6)]
    g, how = graph(spark, edges), Rounds(threshold=1e-12, most=200)
    kernel = php_kernel(0, 0.5)
    found, n = _rounds(monkeypatch, lambda: run_sum(g, kernel, how))
    assert n <= 30  # 40 halvings otherwise
    assert found == pytest.approx(values(run_sum(g, kernel, Rounds(45))), abs=1e-12)


def test_a_portion_is_taken_anew_in_each_round(spark, monkeypatch):
    edges = [(a, (a * 7 + j * j + 3) % 60, 1) for a in range(60) for j in range(6)]
    g, kernel = graph(spark, edges), pagerank_kernel(0.3)
    found, n = _rounds(monkeypatch, lambda: run_sum(g, kernel, Rounds(threshold=1e-8, portion=0.5)))
    assert n <= 40
    assert found == pytest.approx(values(run_sum(g, kernel, Rounds(40))), abs=1e-8)


def test_derived_graphs_are_written_once(spark, sf_dir):
    g = catalog._chain(spark, sf_dir)
    assert all("/deltaweave/" in f for df in (g.edges, g.vertices) for f in df.inputFiles()) and g.vertices.inputFiles()


def test_a_skeleton_joins_labels_once(spark, monkeypatch):
    n, edges, _ = _random(5)
    g, joined, plain = graph(spark, edges, n=n), [], summarize.labelled
    monkeypatch.setattr(summarize, "labelled", lambda *a: joined.append(1) or plain(*a))
    clusters = g.vertices.select("id", F.expr("id div 8").alias("cluster"))
    assert values(dense(g, summarize.SelectSkeleton(g, clusters, SSSP, 0).values(), SSSP)) == _dijkstra(n, edges, 0)
    assert len(joined) == 1
