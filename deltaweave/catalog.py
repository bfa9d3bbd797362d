"""The library's registered queries and their SQL for DuckDB.

All run on the customer chain graph (see ``sources.tables``) unless their name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.functions import BFS, CC, SSSP, SSWP, pagerank_kernel, php_kernel
from deltaweave.operators import accessors, datagen, gcn, incremental, summarize, updates
from deltaweave.operators.fixpoint import Rounds, dense, run_select, run_sum
from deltaweave.plans import algorithms
from deltaweave.session import cut, materialize
from deltaweave.sources import Graph, customer_chain, customer_updates, kept, supplier_part
from deltaweave.sources.tables import dense_rank_in_order

SOURCE = 0
CLUSTER = 50
#: Fewer rounds to convergence, for queries that run to the fixpoint on both sides.
FAST = 0.5
TIGHT = Rounds(threshold=1e-12, most=200)


def _chain(spark: SparkSession, sf_dir: str) -> Graph:
    return kept(customer_chain(spark, sf_dir), ends=True)


def _undirected(spark: SparkSession, sf_dir: str) -> Graph:
    g = _chain(spark, sf_dir)
    return Graph(g.vertices, materialize(updates.to_undirected(g.edges), "edges"), directed=False)


def _batch(g: Graph) -> DataFrame:
    return customer_updates(g, g.vertices.count())


def _clusters(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.expr(f"id div {CLUSTER}").alias("cluster"))


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.select("id", *[F.round(c, digits).alias(c) for c in cols])


def bfs_hops(spark, sf_dir):
    return algorithms.bfs(_chain(spark, sf_dir), SOURCE, True).select("id", F.col("value").cast("long").alias("hops"))


def sssp_dist(spark, sf_dir):
    return algorithms.sssp(_chain(spark, sf_dir), SOURCE, True).select("id", F.col("value").cast("long").alias("dist"))


def sswp_width(spark, sf_dir):
    return algorithms.sswp(_chain(spark, sf_dir), SOURCE, True).select("id", F.col("value").cast("long").alias("width"))


def cc_labels(spark, sf_dir):
    return algorithms.connected_components(_undirected(spark, sf_dir)).select("id", F.col("value").alias("label"))


def cc_bipartite(spark, sf_dir):
    g = supplier_part(spark, sf_dir)
    return algorithms.connected_components(Graph(g.vertices, cut(g.edges), False)).select("id", F.col("value").alias("label"))


def pagerank_20(spark, sf_dir):
    return _rounded(algorithms.pagerank(_chain(spark, sf_dir), Rounds(20)), "value", "delta")


def ppr_20(spark, sf_dir):
    return _rounded(algorithms.personalised_pagerank(_chain(spark, sf_dir), SOURCE, Rounds(20)), "value", "delta")


def php_delta_10(spark, sf_dir):
    return _rounded(algorithms.php(_chain(spark, sf_dir), SOURCE, Rounds(10)), "value", "delta")


def php_10(spark, sf_dir):
    return _rounded(algorithms.php_fixed_rounds(_chain(spark, sf_dir), SOURCE, 10), "value")


def tornado_php_10(spark, sf_dir):
    """Stops early only below a tolerance that ten rounds do not reach."""
    return _rounded(algorithms.php_fixed_rounds(_chain(spark, sf_dir), SOURCE, 10, tolerance=1e-12), "value")


def tornado_pagerank_10(spark, sf_dir):
    return _rounded(algorithms.pagerank_with_sinks(_chain(spark, sf_dir), 10), "value")


GCN_DIMS = gcn.default_dims(2)[-3:]


def _weights() -> list:
    return [gcn.default_weights(a, b) for a, b in zip(GCN_DIMS, GCN_DIMS[1:])]


def _long(features: DataFrame) -> DataFrame:
    return features.select("id", F.posexplode("feature").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 3).alias("x"))


def gcn_layer(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return _long(gcn.forward(g, gcn.initial_features(g, GCN_DIMS[0]), _weights()[:1])[1])


def gcn_forward(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return _long(gcn.forward(g, gcn.initial_features(g, GCN_DIMS[0]), _weights())[-1])


def inc_gcn(spark, sf_dir):
    g = _chain(spark, sf_dir)
    layers = gcn.forward(g, gcn.initial_features(g, GCN_DIMS[0]), _weights())
    return _long(gcn.update(g, layers, _weights(), _batch(g))[1][-1])


def out_degree(spark, sf_dir):
    return accessors.out_degree(customer_chain(spark, sf_dir))


def in_degree(spark, sf_dir):
    return accessors.in_degree(customer_chain(spark, sf_dir))


def top_out_degree(spark, sf_dir):
    return accessors.top_out_degree(customer_chain(spark, sf_dir), 10)


def graph_counts(spark, sf_dir):
    return accessors.counts(customer_chain(spark, sf_dir))


def vertex_set(spark, sf_dir):
    return customer_chain(spark, sf_dir).vertices


def undirected_edges(spark, sf_dir):
    return updates.to_undirected(customer_chain(spark, sf_dir).edges)


def undirected_edges_keep(spark, sf_dir):
    return updates.to_undirected_keep(customer_chain(spark, sf_dir).edges)


def border_vertices(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.border(g, _clusters(g).withColumnRenamed("cluster", "label"))


def destination_parts(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.destination_parts(g, _clusters(g).withColumnRenamed("cluster", "label"))


def apply_updates(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return updates.apply_updates(g, updates.validate(g, _batch(g))).edges


def changed_vertices(spark, sf_dir):
    return updates.changed_vertices(_batch(_chain(spark, sf_dir)))


def effective_updates(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return updates.effective(g, _batch(g))


def _inc_select(g: Graph, kernel, name: str, source: int | None = SOURCE) -> DataFrame:
    after, state = incremental.update_select(g, run_select(g, kernel, source), _batch(g), kernel, source)
    return dense(after, state, kernel, True).select("id", F.col("value").cast("long").alias(name))


def inc_bfs(spark, sf_dir):
    return _inc_select(_chain(spark, sf_dir), BFS, "hops")


def inc_sssp(spark, sf_dir):
    return _inc_select(_chain(spark, sf_dir), SSSP, "dist")


def inc_sswp(spark, sf_dir):
    return _inc_select(_chain(spark, sf_dir), SSWP, "width")


def inc_cc(spark, sf_dir):
    return _inc_select(_undirected(spark, sf_dir), CC, "label", None)


def inc_pagerank(spark, sf_dir):
    g, kernel = _chain(spark, sf_dir), pagerank_kernel(FAST)
    _, state = incremental.update_sum(g, run_sum(g, kernel, TIGHT), _batch(g), kernel, TIGHT)
    return _rounded(state, "value", digits=6)


def inc_php(spark, sf_dir):
    g, kernel = _chain(spark, sf_dir), php_kernel(SOURCE, FAST)
    _, state = incremental.update_sum(g, run_sum(g, kernel, TIGHT), _batch(g), kernel, TIGHT)
    return _rounded(state, "value", digits=6)


def reset_set(spark, sf_dir):
    """Vertices whose hop count hangs on a deleted edge, from parents made unique as the least of their round."""
    g = _chain(spark, sf_dir)
    state = run_select(g, BFS, SOURCE)
    return incremental.reset_set(state, updates.effective(g, _batch(g)).where("op = 'd'")).select("id")


def cluster_entry_exit(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.entry_exit(g, _clusters(g))


def cluster_benefit(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.cluster_benefit(g, _clusters(g))


def cluster_admission(spark, sf_dir):
    """Clusters of four with a benefit over that of four entries, four exits and nothing inside."""
    g = customer_chain(spark, sf_dir)
    return summarize.admit(g, g.vertices.select("id", F.expr("id div 4").alias("cluster")), -16, 2)


def mirror_candidates(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.mirror_candidates(g, _clusters(g), 1)


def mirror_choice(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.mirror_choice(g, _clusters(g), 1)


def node_types(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.node_types(g, _clusters(g).where("cluster % 3 <> 0"))


def compression_stats(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return summarize.compression_stats(g, _clusters(g), 10)


def skeleton_edges(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return summarize.skeleton_edges(g, _clusters(g), SSSP).select("src", "dst", F.col("weight").cast("long").alias("weight"), "kind")


def _skeleton(spark, sf_dir, kernel, name):
    g = _chain(spark, sf_dir)
    state = summarize.skeleton_select(g, _clusters(g), kernel, SOURCE)
    return dense(g, state, kernel, True).select("id", F.col("value").cast("long").alias(name))


def skeleton_bfs(spark, sf_dir):
    return _skeleton(spark, sf_dir, BFS, "hops")


def skeleton_sssp(spark, sf_dir):
    return _skeleton(spark, sf_dir, SSSP, "dist")


def skeleton_sswp(spark, sf_dir):
    return _skeleton(spark, sf_dir, SSWP, "width")


def skeleton_pagerank(spark, sf_dir):
    g = _chain(spark, sf_dir)
    return _rounded(summarize.skeleton_sum(g, _clusters(g), pagerank_kernel(FAST), TIGHT), "value", digits=6)


def split_updates(spark, sf_dir):
    return datagen.split_updates(customer_chain(spark, sf_dir).edges, 0.1)


def reweight(spark, sf_dir):
    return datagen.reweight(customer_chain(spark, sf_dir).edges, 0.05)


def enlarge(spark, sf_dir):
    return datagen.enlarge(customer_chain(spark, sf_dir).edges, 3)


def relabel(spark, sf_dir):
    return datagen.relabel(supplier_part(spark, sf_dir).edges)


def dense_ids(spark, sf_dir):
    return dense_rank_in_order(customer_chain(spark, sf_dir).vertices)


def result_diff(spark, sf_dir):
    """Out-degrees against in-degrees."""
    g = customer_chain(spark, sf_dir)
    a, b = (f(g).select("id", F.col("degree").cast("double").alias("value")).where(w) for f, w in ((accessors.out_degree, "id % 7 <> 0"), (accessors.in_degree, "id % 5 <> 0")))
    return datagen.result_diff(a, b)


QUERIES = (
    bfs_hops, sssp_dist, sswp_width, cc_labels, cc_bipartite, pagerank_20, ppr_20, php_delta_10, php_10, tornado_php_10, tornado_pagerank_10, gcn_layer, gcn_forward,
    out_degree, in_degree, top_out_degree, graph_counts, vertex_set, undirected_edges, undirected_edges_keep, border_vertices, destination_parts,
    apply_updates, changed_vertices, effective_updates, inc_bfs, inc_sssp, inc_sswp, inc_cc, inc_pagerank, inc_php, inc_gcn, reset_set,
    cluster_entry_exit, cluster_benefit, cluster_admission, mirror_candidates, mirror_choice, node_types, compression_stats, skeleton_edges, skeleton_bfs, skeleton_sssp, skeleton_sswp, skeleton_pagerank,
    split_updates, reweight, enlarge, relabel, dense_ids, result_diff,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from deltaweave import catalog_more

    return {f.__name__: f for f in (*QUERIES, *catalog_more.QUERIES)}


# --- SQL -----------------------------------------------------------------------------------------

G = """g AS MATERIALIZED (SELECT src, dst, min(w) AS weight FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst, 1 + o_orderkey % 64 AS w FROM orders) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
v AS MATERIALIZED (SELECT src AS id FROM g UNION SELECT dst FROM g)"""
GU = f"""{G},
u AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY src, dst)"""


def _updates(g: str) -> str:
    """CTEs after ``g`` and ``v``: the batch ``del`` and ``ins``, and the updated edges ``h``."""
    return f""", del AS MATERIALIZED (SELECT src, dst FROM {g} WHERE (src * 31 + dst) % 100 = 0),
ins AS MATERIALIZED (SELECT id AS src, (id * 7 + 3) % (SELECT count(*) FROM v) AS dst, 1 + id % 16 AS weight FROM v WHERE id % 50 = 0 AND (id * 7 + 3) % (SELECT count(*) FROM v) IN (SELECT id FROM v) AND (id * 7 + 3) % (SELECT count(*) FROM v) <> id)"""


def _applied(g: str, undirected: bool = False) -> str:
    mirror = lambda t, w: f"(SELECT * FROM {t} UNION SELECT dst, src{w} FROM {t})" if undirected else t
    return f"""{_updates(g)},
dd AS MATERIALIZED (SELECT src, dst FROM {mirror("del", "")}), ii AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM {mirror("ins", ", weight")} GROUP BY src, dst),
h AS MATERIALIZED (SELECT src, dst, weight FROM {g} WHERE (src, dst) NOT IN (SELECT (src, dst) FROM dd) AND (src, dst) NOT IN (SELECT (src, dst) FROM ii) UNION ALL SELECT src, dst, weight FROM ii)"""


def _select_sql(ctes: str, edges: str, start: str, extend: str, better: str, out: str, unreachable: str) -> str:
    """Improvement rounds until nothing changes; ``better`` is min or max."""
    beats = "<" if better == "min" else ">"
    return f"""WITH RECURSIVE {ctes}, s(id, value) USING KEY (id) AS (
{start}
UNION
SELECT e.dst, {better}({extend}) FROM s JOIN {edges} e ON e.src = s.id LEFT JOIN recurring.s AS c ON c.id = e.dst
WHERE c.value IS NULL OR {extend} {beats} c.value GROUP BY e.dst)
SELECT v.id, CAST(coalesce(s.value, {unreachable}) AS BIGINT) AS {out} FROM v LEFT JOIN s ON s.id = v.id"""


def _selects(ctes: str, edges: str) -> dict[str, str]:
    one = f"SELECT CAST({SOURCE} AS BIGINT), CAST(%s AS BIGINT)"
    return {
        "bfs": _select_sql(ctes, edges, one % 0, "s.value + 1", "min", "hops", "2147483647"),
        "sssp": _select_sql(ctes, edges, one % 0, "s.value + e.weight", "min", "dist", "2147483647"),
        "sswp": _select_sql(ctes, edges, one % 2147483647, "least(s.value, e.weight)", "max", "width", "0"),
    }


def _cc_sql(ctes: str, edges: str) -> str:
    return _select_sql(ctes, edges, "SELECT id, id FROM v", "s.value", "min", "label", "v.id")


def _sum_sql(ctes: str, factors: str, init: str, rounds: int, out: str) -> str:
    return f"""WITH RECURSIVE {ctes}, f AS MATERIALIZED ({factors}), n AS MATERIALIZED (SELECT count(*) AS n FROM v),
s(r, id, value, delta) AS (
SELECT 0, id, CAST(0 AS DOUBLE), CAST({init} AS DOUBLE) FROM v, n
UNION ALL
SELECT a.r + 1, a.id, a.value + a.delta, coalesce(m.d, 0) FROM s a LEFT JOIN (SELECT f.dst AS id, sum(s.delta * f.factor) AS d FROM s JOIN f ON f.src = s.id GROUP BY f.dst) m ON m.id = a.id WHERE a.r < {rounds})
SELECT id, {out} FROM s WHERE r = {rounds}"""


def _degree_factors(edges: str, d: float) -> str:
    return f"SELECT e.src, e.dst, {d} / c.n AS factor FROM {edges} e JOIN (SELECT src, count(*) AS n FROM {edges} GROUP BY src) c ON c.src = e.src"


def _php_factors(edges: str, d: float) -> str:
    return f"SELECT e.src, e.dst, {d} * e.weight / c.n AS factor FROM {edges} e JOIN (SELECT src, CAST(sum(weight) AS DOUBLE) AS n FROM {edges} WHERE dst <> {SOURCE} GROUP BY src) c ON c.src = e.src WHERE e.dst <> {SOURCE}"


def _vector_sql(factors: str, start: str, step: str, extra: str = "") -> str:
    return f"""WITH RECURSIVE {G}, f AS MATERIALIZED ({factors}), n AS MATERIALIZED (SELECT count(*) AS n FROM v){extra},
s(r, id, value, last) AS (
SELECT 0, id, CAST({start} AS DOUBLE), CAST(0 AS DOUBLE) FROM v
UNION ALL
SELECT a.r + 1, a.id, {step} + coalesce(m.d, 0), a.value FROM s a CROSS JOIN n LEFT JOIN (SELECT f.dst AS id, sum(s.value * f.factor) AS d FROM s JOIN f ON f.src = s.id GROUP BY f.dst) m ON m.id = a.id WHERE a.r < 10)
SELECT id, round(value, 9) AS value FROM s WHERE r = 10"""


def _weights_sql(k: int) -> str:
    rows = [f"({i}, {j}, {x!r})" for i, row in enumerate(_weights()[k]) for j, x in enumerate(row)]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t(i, j, w))"


def _gcn_sql(ctes: str, edges: str, layers: int) -> str:
    sql = f"WITH {ctes}, h0 AS (SELECT id, i, CAST(id + i AS DOUBLE) AS x FROM v, range({GCN_DIMS[0]}) t(i))"
    for k in range(layers):
        x = "greatest(x, 0)" if k else "x"
        sql += f""", p{k} AS MATERIALIZED (SELECT id, j, sum({x} * CAST(w AS DOUBLE)) AS y FROM h{k} JOIN {_weights_sql(k)} USING (i) GROUP BY id, j),
h{k + 1} AS MATERIALIZED (SELECT v.id, d.i, coalesce(a.x, 0) AS x FROM v CROSS JOIN range({GCN_DIMS[k + 1]}) d(i) LEFT JOIN (SELECT e.dst AS id, j AS i, sum(y) AS x FROM p{k} JOIN {edges} e ON e.src = p{k}.id GROUP BY ALL) a ON a.id = v.id AND a.i = d.i)"""
    return f"{sql} SELECT id, CAST(i AS BIGINT) AS dim, round(x, 3) AS x FROM h{layers}"


L = f"""{G}, l AS MATERIALIZED (SELECT id, id // {CLUSTER} AS label FROM v),
o AS MATERIALIZED (SELECT g.*, a.label AS a, b.label AS b FROM g LEFT JOIN l a ON a.id = g.src LEFT JOIN l b ON b.id = g.dst)"""
ENDS = "SELECT l.id, l.label AS cluster, l.id IN (SELECT dst FROM o WHERE a <> b) AS is_entry, l.id IN (SELECT src FROM o WHERE a <> b) AS is_exit FROM l"
BENEFIT = f"""SELECT e.cluster, count(*) AS n_members, coalesce(any_value(i.n), 0) AS n_inner, CAST(sum(CAST(is_entry AS BIGINT)) AS BIGINT) AS n_entry, CAST(sum(CAST(is_exit AS BIGINT)) AS BIGINT) AS n_exit,
CAST(coalesce(any_value(i.n), 0) - sum(CAST(is_entry AS BIGINT)) * sum(CAST(is_exit AS BIGINT)) AS BIGINT) AS benefit
FROM ({ENDS}) e LEFT JOIN (SELECT a, count(*) AS n FROM o WHERE a = b GROUP BY a) i ON i.a = e.cluster GROUP BY e.cluster"""
MIRRORS = """SELECT b AS cluster, src AS id, 'in' AS side, count(*) AS n FROM o WHERE a <> b GROUP BY b, src HAVING count(*) > 1
UNION ALL SELECT a, dst, 'out', count(*) FROM o WHERE a <> b GROUP BY a, dst HAVING count(*) > 1"""
TICKET = f"((src % {datagen.MODULUS}) * 7919 + (dst % {datagen.MODULUS}) * 104729 + 10) % {datagen.MODULUS}"


def _choice_sql() -> str:
    cases = []
    for i, o in ((0, 0), (1, 0), (0, 1), (1, 1)):
        cases.append(f"n_inner + {i} * (ie - im) + {o} * (oe - om) - (n_entry - {i} * if_ + {i} * im) * (n_exit - {o} * of_ + {o} * om)")
    none, only_in, only_out, both = (f"({c})" for c in cases)
    return f"""WITH {L}, m AS MATERIALIZED ({MIRRORS}), b AS ({BENEFIT}),
fi AS (SELECT cluster, count(*) AS n FROM (SELECT o.b AS cluster, o.dst FROM o LEFT JOIN m ON m.side = 'in' AND m.cluster = o.b AND m.id = o.src WHERE o.a <> o.b GROUP BY o.b, o.dst HAVING count(*) = count(m.id)) GROUP BY cluster),
fo AS (SELECT cluster, count(*) AS n FROM (SELECT o.a AS cluster, o.src FROM o LEFT JOIN m ON m.side = 'out' AND m.cluster = o.a AND m.id = o.dst WHERE o.a <> o.b GROUP BY o.a, o.src HAVING count(*) = count(m.id)) GROUP BY cluster),
mi AS (SELECT cluster, count(*) AS n, sum(n) AS e FROM m WHERE side = 'in' GROUP BY cluster), mo AS (SELECT cluster, count(*) AS n, sum(n) AS e FROM m WHERE side = 'out' GROUP BY cluster),
t AS (SELECT b.*, coalesce(fi.n, 0) AS if_, coalesce(fo.n, 0) AS of_, coalesce(mi.n, 0) AS im, coalesce(mi.e, 0) AS ie, coalesce(mo.n, 0) AS om, coalesce(mo.e, 0) AS oe FROM b LEFT JOIN fi USING (cluster) LEFT JOIN fo USING (cluster) LEFT JOIN mi USING (cluster) LEFT JOIN mo USING (cluster)),
c AS (SELECT cluster, {none} AS c0, {only_in} AS c1, {only_out} AS c2, {both} AS c3 FROM t)
SELECT cluster, CASE greatest(c0, c1, c2, c3) WHEN c0 THEN 'none' WHEN c1 THEN 'in' WHEN c2 THEN 'out' ELSE 'both' END AS mirrors, CAST(greatest(c0, c1, c2, c3) AS BIGINT) AS benefit FROM c"""


def _skeleton_edges_sql() -> str:
    return f"""WITH RECURSIVE {L}, x AS MATERIALIZED ({ENDS}), s(entry, id, value) USING KEY (entry, id) AS (
SELECT id, id, CAST(0 AS BIGINT) FROM x WHERE is_entry
UNION
SELECT s.entry, o.dst, min(s.value + o.weight) FROM s JOIN o ON o.src = s.id AND o.a = o.b LEFT JOIN recurring.s AS c ON c.entry = s.entry AND c.id = o.dst
WHERE c.value IS NULL OR s.value + o.weight < c.value GROUP BY s.entry, o.dst)
SELECT s.entry AS src, s.id AS dst, s.value AS weight, 'shortcut' AS kind FROM s JOIN x ON x.id = s.id AND x.is_exit WHERE s.entry <> s.id
UNION ALL SELECT src, dst, weight, 'edge' FROM o WHERE a <> b"""


def oracle_sql() -> dict[str, str]:
    from deltaweave import catalog_more

    found = _oracle_sql()
    return found | catalog_more.oracle_sql(found)


def _oracle_sql() -> dict[str, str]:
    plain, after, after_u = _selects(G, "g"), _selects(G + _applied("g"), "h"), _cc_sql(GU + _applied("u", True), "h")
    value, both = "round(value, 9) AS value", "round(value, 9) AS value, round(delta, 9) AS delta"
    start = f"CASE WHEN id = {SOURCE} THEN 1.0 ELSE 0.0 END"
    upd = G + _applied("g")
    half = int(0.1 * datagen.MODULUS / 2)
    return {
        "bfs_hops": plain["bfs"], "sssp_dist": plain["sssp"], "sswp_width": plain["sswp"], "cc_labels": _cc_sql(GU, "u"),
        "cc_bipartite": _cc_sql("w AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), u AS MATERIALIZED (SELECT a AS src, b AS dst FROM w UNION ALL SELECT b, a FROM w), v AS MATERIALIZED (SELECT DISTINCT src AS id FROM u)", "u"),
        "pagerank_20": _sum_sql(G, _degree_factors("g", 0.85), "0.15 / n", 20, both), "ppr_20": _sum_sql(G, _degree_factors("g", 0.85), f"CASE WHEN id = {SOURCE} THEN 0.15 / n ELSE 0 END", 20, both),
        "php_delta_10": _sum_sql(G, _php_factors("g", 0.8), start, 10, both),
        "php_10": _vector_sql(_php_factors("g", 0.8), start, f"CASE WHEN a.id = {SOURCE} THEN 1.0 ELSE 0.0 END"), "tornado_php_10": _vector_sql(_php_factors("g", 0.8), start, f"CASE WHEN a.id = {SOURCE} THEN 1.0 ELSE 0.0 END"),
        "tornado_pagerank_10": _vector_sql(_degree_factors("g", 0.85), "0", "(0.15 / n.n + 0.85 * (SELECT coalesce(sum(last), 0) FROM s WHERE id IN (SELECT id FROM sink)) / n.n)", ", sink AS MATERIALIZED (SELECT id FROM v WHERE id NOT IN (SELECT src FROM g))"),
        "gcn_layer": _gcn_sql(G, "g", 1), "gcn_forward": _gcn_sql(G, "g", 2), "inc_gcn": _gcn_sql(upd, "h", 2),
        "out_degree": f"WITH {G} SELECT v.id, count(g.src) AS degree FROM v LEFT JOIN g ON g.src = v.id GROUP BY v.id", "in_degree": f"WITH {G} SELECT v.id, count(g.src) AS degree FROM v LEFT JOIN g ON g.dst = v.id GROUP BY v.id",
        "top_out_degree": f"WITH {G} SELECT v.id, count(g.src) AS degree FROM v LEFT JOIN g ON g.src = v.id GROUP BY v.id ORDER BY degree DESC, v.id LIMIT 10",
        "graph_counts": f"WITH {G} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM g) AS n_edges", "vertex_set": f"WITH {G} SELECT id FROM v",
        "undirected_edges": f"WITH {GU} SELECT * FROM u", "undirected_edges_keep": f"WITH {G} SELECT * FROM g UNION ALL SELECT dst, src, weight FROM g WHERE (dst, src) NOT IN (SELECT (src, dst) FROM g)",
        "border_vertices": f"WITH {L} SELECT id, bool_or(i) AS incoming, bool_or(x) AS outgoing FROM (SELECT dst AS id, true AS i, false AS x FROM o WHERE a <> b UNION ALL SELECT src, false, true FROM o WHERE a <> b) GROUP BY id",
        "destination_parts": f"WITH {L} SELECT DISTINCT src AS id, b AS label FROM o WHERE a <> b",
        "apply_updates": f"WITH {upd} SELECT * FROM h", "changed_vertices": f"WITH {G}{_updates('g')} SELECT DISTINCT dst AS id FROM del",
        "effective_updates": f"""WITH {upd}, same AS (SELECT ii.src, ii.dst FROM ii JOIN g USING (src, dst, weight)),
eu AS (SELECT 'd' AS op, src, dst, weight FROM g WHERE (src, dst) IN (SELECT (src, dst) FROM dd UNION SELECT (src, dst) FROM ii) UNION ALL SELECT 'a', src, dst, weight FROM ii)
SELECT * FROM eu WHERE (src, dst) NOT IN (SELECT (src, dst) FROM same)""",
        "inc_bfs": after["bfs"], "inc_sssp": after["sssp"], "inc_sswp": after["sswp"], "inc_cc": after_u,
        "inc_pagerank": _sum_sql(upd, _degree_factors("h", FAST), f"{1 - FAST} / n", 60, "round(value, 6) AS value"), "inc_php": _sum_sql(upd, _php_factors("h", FAST), start, 60, "round(value, 6) AS value"),
        "reset_set": f"""WITH RECURSIVE {upd}, s(id, value) USING KEY (id) AS (SELECT CAST({SOURCE} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT g.dst, min(s.value + 1) FROM s JOIN g ON g.src = s.id LEFT JOIN recurring.s AS c ON c.id = g.dst WHERE c.value IS NULL GROUP BY g.dst),
p AS MATERIALIZED (SELECT g.dst AS id, min(g.src) AS parent FROM g JOIN s a ON a.id = g.src JOIN s b ON b.id = g.dst AND b.value = a.value + 1 GROUP BY g.dst),
x AS MATERIALIZED (SELECT src, dst FROM g WHERE (src, dst) NOT IN (SELECT (src, dst) FROM h) OR (src, dst) IN (SELECT (g2.src, g2.dst) FROM g g2 JOIN h USING (src, dst) WHERE g2.weight <> h.weight)),
t(id) AS (SELECT p.id FROM p JOIN x ON x.src = p.parent AND x.dst = p.id UNION SELECT p.id FROM t JOIN p ON p.parent = t.id) SELECT id FROM t""",
        "cluster_entry_exit": f"WITH {L} {ENDS}", "cluster_benefit": f"WITH {L} {BENEFIT}",
        "cluster_admission": f"WITH {L.replace(f'id // {CLUSTER}', 'id // 4')} SELECT id, label AS cluster FROM l WHERE label IN (SELECT cluster FROM ({BENEFIT}) WHERE benefit > -16 AND n_members >= 2)",
        "mirror_candidates": f"WITH {L} {MIRRORS}", "mirror_choice": _choice_sql(),
        "node_types": f"""WITH {G}, l AS MATERIALIZED (SELECT id, id // {CLUSTER} AS label FROM v WHERE (id // {CLUSTER}) % 3 <> 0),
o AS MATERIALIZED (SELECT g.*, coalesce(a.label, -1) AS a, coalesce(b.label, -1) AS b FROM g LEFT JOIN l a ON a.id = g.src LEFT JOIN l b ON b.id = g.dst), x AS ({ENDS})
SELECT v.id, CASE WHEN x.id IS NULL THEN 'Single' WHEN is_entry AND is_exit THEN 'BothOutIn' WHEN is_entry THEN 'OnlyIn' WHEN is_exit THEN 'OnlyOut' ELSE 'Inner' END AS node_type FROM v LEFT JOIN x ON x.id = v.id""",
        "compression_stats": f"WITH {L} SELECT n_members // 10 AS bin, count(*) AS n_clusters, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_members", "n_inner", "n_entry", "n_exit")) + f" FROM ({BENEFIT}) GROUP BY bin",
        "skeleton_edges": _skeleton_edges_sql(), "skeleton_bfs": plain["bfs"], "skeleton_sssp": plain["sssp"], "skeleton_sswp": plain["sswp"],
        "skeleton_pagerank": _sum_sql(G, _degree_factors("g", FAST), f"{1 - FAST} / n", 60, "round(value, 6) AS value"),
        "split_updates": f"""WITH {G}, t AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, {TICKET} AS t FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY src, t < {2 * half} ORDER BY t, dst, weight) AS k FROM t)
SELECT src, dst, weight, CASE WHEN t >= {2 * half} OR k > n - greatest(2, ceil(n * 0.2)) THEN 'base' WHEN t < {half} THEN 'add' ELSE 'delete' END AS part FROM r""",
        "reweight": f"WITH {G}, c AS (SELECT * FROM g WHERE {TICKET} < {int(0.05 * datagen.MODULUS)}) SELECT 'd' AS op, src, dst, weight FROM c UNION ALL SELECT 'a', src, dst, (weight * 7 + src + dst) % 64 + 1 FROM c",
        "enlarge": f"WITH {G}, w AS (SELECT max(greatest(src, dst)) + 1 AS w FROM g) SELECT src + k * w AS src, dst + k * w AS dst, weight FROM g, w, range(3) t(k) UNION ALL SELECT 0, k * w, 1 FROM w, range(1, 3) t(k)",
        "relabel": "WITH w AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), e AS (SELECT a AS src, b AS dst FROM w UNION ALL SELECT b, a FROM w), d AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)) SELECT x.k AS src, y.k AS dst, CAST(1 AS BIGINT) AS weight FROM e JOIN d x ON x.id = e.src JOIN d y ON y.id = e.dst",
        "dense_ids": f"WITH {G} SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM v",
        "result_diff": f"""WITH {G}, x AS (SELECT v.id, CAST(count(g.src) AS DOUBLE) AS value FROM v LEFT JOIN g ON g.src = v.id WHERE v.id % 7 <> 0 GROUP BY v.id), y AS (SELECT v.id, CAST(count(g.src) AS DOUBLE) AS value FROM v LEFT JOIN g ON g.dst = v.id WHERE v.id % 5 <> 0 GROUP BY v.id)
SELECT count(x.id + y.id) AS n_both, count(x.id) - count(x.id + y.id) AS n_left, count(y.id) - count(x.id + y.id) AS n_right, sum(abs(x.value - y.value)) AS sum_diff, count(CASE WHEN abs(x.value - y.value) > 1e-5 THEN 1 END) AS n_diff FROM x FULL JOIN y ON x.id = y.id""",
    }
