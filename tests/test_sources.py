"""Text formats, streams and saved graphs."""

import re

import pytest

from deltaweave.functions import SSSP
from deltaweave.operators import datagen
from deltaweave.operators.fixpoint import dense
from deltaweave.sources import Graph, read_adjacency, read_clusters, read_edges, read_graph, read_matrix_market, read_temporal_log, read_updates, write_clusters, write_edges, write_result, write_updates
from deltaweave.sources import tables
from deltaweave.streaming import MaintainedResult, update_stream


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_edges(spark, tmp_path):
    path = put(tmp_path, "g.e", "# comment\n0 1 5\n\n1\t2  7\n2 2\n")
    assert sorted(map(tuple, read_edges(spark, path).collect())) == [(0, 1, 5), (1, 2, 7), (2, 2, 1)]
    bad = put(tmp_path, "bad.e", "0 x\n1 2\n")
    with pytest.raises(Exception, match="not a number"):
        read_edges(spark, bad).collect()
    assert read_edges(spark, bad, mode="PERMISSIVE").count() == 1
    g = read_graph(spark, path, str(tmp_path / "missing.v"))
    assert sorted(r[0] for r in g.vertices.collect()) == [0, 1, 2]
    assert read_graph(spark, path, put(tmp_path, "g.v", "0\n1\n2\n9 x\n"), directed=False).edges.count() == 6
    with pytest.raises(ValueError):
        read_graph(spark, path, put(tmp_path, "short.v", "0\n1\n"))


def test_updates_and_clusters(spark, tmp_path):
    path = put(tmp_path, "g.update", "a 0 1 5\nd 1 2\n")
    assert [tuple(r)[:4] for r in read_updates(spark, path).orderBy("line").collect()] == [("a", 0, 1, 5), ("d", 1, 2, None)]
    with pytest.raises(Exception, match="unknown update"):
        read_updates(spark, put(tmp_path, "bad.update", "x 0 1\n")).collect()
    c = read_clusters(spark, put(tmp_path, "g.c_9", "3 4 2 8\n1 7\n"), min_size=2)
    assert sorted(map(tuple, c.collect())) == [(2, 2), (4, 2), (8, 2)]
    write_clusters(c, str(tmp_path / "out.c"))
    assert spark.read.text(str(tmp_path / "out.c")).first()[0] == "3 2 4 8"
    write_updates(read_updates(spark, path), str(tmp_path / "out.update"))
    assert read_updates(spark, str(tmp_path / "out.update")).count() == 2


def test_other_formats(spark, tmp_path):
    assert sorted(map(tuple, read_matrix_market(spark, put(tmp_path, "m.mtx", "%%MatrixMarket\n3 3 2\n1 2 0.5\n3 1\n")).collect())) == [(1, 2, 0.5), (3, 1, 1.0)]
    assert sorted(map(tuple, read_adjacency(spark, put(tmp_path, "g.adj", "0 1 2\n3\n")).collect())) == [(0, 1, 1), (0, 2, 1)]
    base, ups = read_temporal_log(spark, put(tmp_path, "w.log", "0 1 2\n1 2 2\n0 1 1\n2 0 4\n2 0 1\n"))
    assert sorted(map(tuple, base.select("src", "dst").collect())) == [(0, 1), (1, 2)]
    assert sorted(map(tuple, ups.select("op", "src", "dst").collect())) == [("d", 0, 1), ("d", 2, 0)]


def test_results_and_saved_graphs(spark, tmp_path):
    write_result(spark.createDataFrame([(1, 0.5), (2, None)], "id long, value double"), str(tmp_path / "r"), unreachable="inf")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["1 5.000000000000000e-01", "2 inf"]
    g = Graph.of(spark.createDataFrame([(0, 1, 2)], "src long, dst long, weight long"))
    g.save(str(tmp_path / "g"))
    assert Graph.load(spark, str(tmp_path / "g")).edges.collect() == g.edges.collect()
    write_edges(g.edges, str(tmp_path / "e"))
    assert read_edges(spark, str(tmp_path / "e")).collect() == g.edges.collect()


def test_stream(spark, tmp_path):
    g = Graph.of(spark.createDataFrame([(0, 1, 1), (0, 2, 4), (1, 2, 2), (2, 3, 1)], "src long, dst long, weight long"))
    kept = MaintainedResult(g, SSSP, 0)
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a", "d 1 2\n")
    query = kept.follow(update_stream(spark, str(tmp_path / "in")), str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
        put(tmp_path / "in", "b", "a 0 3 1\nd 0 1\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["id"]: r["value"] for r in dense(kept.graph, kept.state, SSSP).collect()} == {0: 0, 1: None, 2: 4, 3: 1}
    kept.apply(spark.createDataFrame([("d", 0, 3, None)], "op string, src long, dst long, weight long"), kept.last)
    assert {r["id"]: r["value"] for r in kept.state.collect()}[3] == 1


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    edges = spark.range(1000).selectExpr("id * 3 as src", "id * 3 + 3 as dst", "id as weight")
    found = datagen.relabel(edges)
    assert sorted(found.collect()) == [(k, k + 1, k) for k in range(1000)]
    assert "hashpartitioning(dst, 10)" in re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
