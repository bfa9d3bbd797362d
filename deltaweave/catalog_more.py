"""More registered queries: files, accessors, skeleton and incremental runs, generators, streams; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave import catalog as c
from deltaweave.functions import BFS, SSSP, SSWP, pagerank_kernel, personalised_pagerank_kernel, php_kernel
from deltaweave.operators import accessors, datagen, incremental, summarize, updates
from deltaweave.operators.fixpoint import Rounds, dense, run_select, run_sum
from deltaweave.plans import algorithms
from deltaweave.plans.run import Options, run
from deltaweave.session import cut, scratch_dir
from deltaweave.sources import Graph, customer_chain
from deltaweave.sources import text
from deltaweave.sources.tables import dense_rank_in_order
from deltaweave.streaming.updates import MaintainedResult, update_stream

SOURCE, FAST, TIGHT = c.SOURCE, c.FAST, c.TIGHT


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/deltaweave/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("value", 6).alias("value"))


# --- drivers and repairs ------------------------------------------------------------------------------


def portion_pagerank(spark, sf_dir):
    """Only the larger half of the pending deltas moves in each round; the fixpoint is the same."""
    return _rounded(run_sum(c._chain(spark, sf_dir), pagerank_kernel(0.3), Rounds(threshold=1e-8, portion=0.5)))


def sparse_sssp(spark, sf_dir):
    """Rounds that look at the frontier alone, as on large graphs."""
    g = c._chain(spark, sf_dir)
    return dense(g, run_select(g, SSSP, SOURCE, sparse=True), SSSP, True).select("id", F.col("value").cast("long").alias("dist"))


def rerun_sssp(spark, sf_dir):
    """The full rerun on the updated graph that repairs are held against."""
    g = c._chain(spark, sf_dir)
    after = Graph(g.vertices, cut(updates.apply_updates(g, c._batch(g)).edges))
    return algorithms.sssp(after, SOURCE, True).select("id", F.col("value").cast("long").alias("dist"))


def reset_stats(spark, sf_dir):
    g = c._chain(spark, sf_dir)
    state = cut(run_select(g, BFS, SOURCE))
    reset = incremental.reset_set(state, updates.effective(g, c._batch(g)).where("op = 'd'"))
    return incremental.reset_statistics(state, reset).select("n_reset", F.round("share", 9).alias("share"))


def inc_ppr(spark, sf_dir):
    g, kernel = c._chain(spark, sf_dir), personalised_pagerank_kernel(SOURCE, FAST)
    return _rounded(incremental.update_sum(g, run_sum(g, kernel, TIGHT), c._batch(g), kernel, TIGHT)[1])


def active_edges_bfs(spark, sf_dir):
    """Edges over which something is sent, by round, as observed in the run."""
    sent: list[int] = []
    run_select(c._chain(spark, sf_dir), BFS, SOURCE, sent=sent)
    return spark.createDataFrame([(k, n) for k, n in enumerate(sent, 1) if n], "round long, n_edges long")


def tornado_php_tolerance(spark, sf_dir):
    """Whole-vector rounds until one moves values by less than the tolerance."""
    return _rounded(algorithms.php_fixed_rounds(c._chain(spark, sf_dir), SOURCE, 40, FAST, 1e-3))


def tornado_pagerank_tolerance(spark, sf_dir):
    return _rounded(algorithms.pagerank_with_sinks(c._chain(spark, sf_dir), 40, FAST, 1e-3))


# --- accessors ----------------------------------------------------------------------------------------


def _some(g: Graph) -> DataFrame:
    return g.vertices.where("id % 97 = 0")


def out_neighbours(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.neighbours(g, _some(g))


def in_neighbours(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.neighbours(g, _some(g), out=False)


def with_child(spark, sf_dir):
    return accessors.with_child(customer_chain(spark, sf_dir))


def with_parent(spark, sf_dir):
    return accessors.with_parent(customer_chain(spark, sf_dir))


def min_out_degree(spark, sf_dir):
    return accessors.bottom_out_degree(customer_chain(spark, sf_dir), 10)


def _labels(g: Graph) -> DataFrame:
    return c._clusters(g).withColumnRenamed("cluster", "label")


def source_parts(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.destination_parts(g, _labels(g), "in")


def either_parts(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.destination_parts(g, _labels(g), "both")


def inner_neighbours(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.neighbours_within(g, _labels(g))


def outer_neighbours(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.neighbours_within(g, _labels(g), inner=False)


def part_neighbours(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return accessors.neighbours_within(g, _labels(g), part=1)


# --- files --------------------------------------------------------------------------------------------


def text_graph(spark, sf_dir):
    """Vertices and edges written as text and loaded again, with the endpoints checked."""
    g, path = customer_chain(spark, sf_dir), _folder(spark, "text")
    text.write_edges(g.edges, f"{path}/e")
    g.vertices.select(F.col("id").cast("string").alias("value")).write.text(f"{path}/v")
    return text.read_graph(spark, f"{path}/e", f"{path}/v").edges


def text_undirected(spark, sf_dir):
    """The edge file alone, both directions; the vertex file named is absent."""
    path = _folder(spark, "text")
    text.write_edges(customer_chain(spark, sf_dir).edges, path)
    g = text.read_graph(spark, path, f"{path}-absent", directed=False)
    return accessors.counts(g)


def cached_graph(spark, sf_dir):
    """Loaded twice: the second time from the cache."""
    path = _folder(spark, "text")
    text.write_edges(customer_chain(spark, sf_dir).edges, f"{path}/e")
    for _ in range(2):
        g = text.cached_graph(spark, f"{path}/cache", f"{path}/e")
    return g.edges


def text_updates(spark, sf_dir):
    g, path = c._chain(spark, sf_dir), _folder(spark, "text")
    text.write_updates(c._batch(g), path)
    return updates.effective(g, text.read_updates(spark, path))


def text_clusters(spark, sf_dir):
    path = _folder(spark, "text")
    text.write_clusters(c._clusters(customer_chain(spark, sf_dir)), path)
    return text.read_clusters(spark, path)


def text_adjacency(spark, sf_dir):
    path = _folder(spark, "text")
    lists = customer_chain(spark, sf_dir).edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    lists.select(F.concat_ws(" ", F.col("src").cast("string"), F.expr("transform(d, x -> cast(x as string))")).alias("value")).write.text(path)
    return text.read_adjacency(spark, path)


def text_temporal(spark, sf_dir):
    """A log of base edges, deletes and adds; the updates in it."""
    g, path = c._chain(spark, sf_dir), _folder(spark, "text")
    ups = updates.normalise(c._batch(g)).select("src", "dst", F.when(F.col("op") == "a", 4).otherwise(1).alias("code"))
    log = g.edges.select("src", "dst", F.lit(2).alias("code")).unionByName(ups)
    log.select(F.concat_ws(" ", "src", "dst", "code").alias("value")).write.text(path)
    return text.read_temporal_log(spark, path)[1]


def text_result(spark, sf_dir):
    """Hop counts as the lines of a result file."""
    g, path = c._chain(spark, sf_dir), _folder(spark, "text")
    text.write_result(algorithms.bfs(g, SOURCE), path, unreachable="2147483647")
    return spark.read.text(path).select(F.col("value").alias("line"))


def run_sssp(spark, sf_dir):
    """The one entry: files in, base run, repair after the updates, result."""
    g, path = c._chain(spark, sf_dir), _folder(spark, "run")
    text.write_edges(g.edges, f"{path}/e")
    text.write_updates(c._batch(g), f"{path}/u")
    found = run(spark, "sssp", f"{path}/e", efile_update=f"{path}/u", out=f"{path}/out", options=Options(source=SOURCE))
    return found.select("id", F.coalesce("value", F.lit(SSSP.unreachable)).cast("long").alias("dist"))


def run_pagerank(spark, sf_dir):
    path = _folder(spark, "run")
    text.write_edges(customer_chain(spark, sf_dir).edges, path)
    return _rounded(run(spark, "pagerank", path, options=Options(damping=FAST, termcheck_threshold=1e-12)))


def run_wcc_compressed(spark, sf_dir):
    """Components over the skeleton of clusters found by label propagation."""
    path = _folder(spark, "run")
    text.write_edges(customer_chain(spark, sf_dir).edges, path)
    return run(spark, "wcc", path, options=Options(compress=True, compress_threshold=-1e9)).select("id", F.col("value").alias("label"))


def stream_sssp(spark, sf_dir):
    """Update files as a stream; the state is written after each batch, and the result read back from there."""
    g, path = c._chain(spark, sf_dir), _folder(spark, "stream")
    text.write_updates(c._batch(g), f"{path}/in")
    kept = MaintainedResult(g, SSSP, SOURCE, folder=f"{path}/state")
    kept.follow(update_stream(spark, f"{path}/in"), f"{path}/checkpoint", availableNow=True).awaitTermination()
    again = MaintainedResult(g, SSSP, SOURCE, folder=f"{path}/state")
    return dense(again.graph, again.state, SSSP, True).select("id", F.col("value").cast("long").alias("dist"))


# --- skeleton -----------------------------------------------------------------------------------------


def skeleton_cc(spark, sf_dir):
    g = c._undirected(spark, sf_dir)
    return summarize.skeleton_components(g, c._clusters(g)).select("id", F.col("value").alias("label"))


def skeleton_php(spark, sf_dir):
    g = c._chain(spark, sf_dir)
    return _rounded(summarize.skeleton_sum(g, c._clusters(g), php_kernel(SOURCE, FAST), TIGHT))


def skeleton_ppr(spark, sf_dir):
    g = c._chain(spark, sf_dir)
    return _rounded(summarize.skeleton_sum(g, c._clusters(g), personalised_pagerank_kernel(SOURCE, FAST), TIGHT))


def _inc_skeleton(spark, sf_dir, kernel, name):
    g = c._chain(spark, sf_dir)
    skeleton = summarize.SelectSkeleton(g, c._clusters(g), kernel, SOURCE)
    skeleton.update(c._batch(g))
    return dense(g, skeleton.values(), kernel, True).select("id", F.col("value").cast("long").alias(name))


def inc_skeleton_bfs(spark, sf_dir):
    return _inc_skeleton(spark, sf_dir, BFS, "hops")


def inc_skeleton_sssp(spark, sf_dir):
    return _inc_skeleton(spark, sf_dir, SSSP, "dist")


def inc_skeleton_sswp(spark, sf_dir):
    return _inc_skeleton(spark, sf_dir, SSWP, "width")


def inc_skeleton_pagerank(spark, sf_dir):
    g = c._chain(spark, sf_dir)
    skeleton = summarize.SumSkeleton(g, c._clusters(g), pagerank_kernel(FAST), TIGHT)
    skeleton.update(c._batch(g))
    return _rounded(skeleton.values())


def mirror_sssp(spark, sf_dir):
    """Every vertex with more than one edge into or out of a cluster has a mirror there."""
    g = c._chain(spark, sf_dir)
    state = summarize.skeleton_select(g, c._clusters(g), SSSP, SOURCE, mirror_k=1, every=True)
    return dense(g, state, SSSP, True).select("id", F.col("value").cast("long").alias("dist"))


def mirror_inc_pagerank(spark, sf_dir):
    """The same with a sum kernel, and a batch after it."""
    g = c._chain(spark, sf_dir)
    skeleton = summarize.SumSkeleton(g, c._clusters(g), pagerank_kernel(FAST), TIGHT, 1, True)
    skeleton.update(c._batch(g))
    return _rounded(skeleton.values())


def mirror_node_types(spark, sf_dir):
    """All node types: vertices with an in-mirror elsewhere are masters."""
    g = customer_chain(spark, sf_dir)
    return summarize.node_types(g, c._clusters(g), summarize.mirror_candidates(g, c._clusters(g), 1).where("side = 'in'"))


def finish_pagerank(spark, sf_dir):
    """Plain iteration from a skeleton's result that stopped early."""
    g, kernel = c._chain(spark, sf_dir), pagerank_kernel(FAST)
    early = summarize.skeleton_sum(g, c._clusters(g), kernel, Rounds(threshold=1e-2))
    return _rounded(summarize.finish_sum(g, early, kernel, TIGHT))


def shortcuts_reversed(spark, sf_dir):
    g = c._chain(spark, sf_dir)
    return summarize.reverse_shortcuts(summarize.select_shortcuts(g, c._clusters(g), SSSP)).select("target", "entry", F.col("dist").cast("long").alias("dist"))


def shortcuts_saved(spark, sf_dir):
    """A run on the skeleton with shortcuts that were written and read again."""
    g, path = c._chain(spark, sf_dir), _folder(spark, "shortcuts")
    summarize.save_shortcuts(summarize.select_shortcuts(g, c._clusters(g), SSSP, SOURCE), path)
    skeleton = summarize.SelectSkeleton(g, c._clusters(g), SSSP, SOURCE, summarize.load_shortcuts(spark, path))
    return dense(g, skeleton.values(), SSSP, True).select("id", F.col("value").cast("long").alias("dist"))


def skeleton_text(spark, sf_dir):
    g, path = c._chain(spark, sf_dir), _folder(spark, "skeleton")
    summarize.write_skeleton(summarize.skeleton_edges(g, c._clusters(g), SSSP), path)
    f = F.split("value", " ")
    return spark.read.text(path).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("long").alias("weight"), f[3].alias("kind"))


# --- generators ---------------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """The graph's edges as lines in the order of (src, dst)."""
    edges = customer_chain(spark, sf_dir).edges.withColumn("key", F.col("src") * (1 << 31) + F.col("dst"))
    return dense_rank_in_order(edges, "key", "line", 1 << 40).select("line", "src", "dst", "weight")


def position_split(spark, sf_dir):
    return datagen.split_by_position(_lines(spark, sf_dir), 0.1)


def first_appearance(spark, sf_dir):
    return datagen.by_first_appearance(_lines(spark, sf_dir))


def vertex_order(spark, sf_dir):
    g = customer_chain(spark, sf_dir)
    return datagen.vertex_order(g.vertices.select("id", F.expr("id % 37").alias("cluster")))


def generated_set(spark, sf_dir):
    """A data set end to end: base, updates and updated edges agree."""
    base, batch, after = datagen.generate(_lines(spark, sf_dir), 0.2)
    base, batch = cut(base), cut(batch)
    applied = updates.apply_updates(Graph.of(base), batch).edges.select("src", "dst", "weight")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(applied.exceptAll(after.select("src", "dst", "weight")), "n_wrong").crossJoin(n(after.exceptAll(applied.select(after.columns)), "n_lost"))


QUERIES = (
    portion_pagerank, sparse_sssp, rerun_sssp, reset_stats, inc_ppr, active_edges_bfs, tornado_php_tolerance, tornado_pagerank_tolerance,
    out_neighbours, in_neighbours, with_child, with_parent, min_out_degree, source_parts, either_parts, inner_neighbours, outer_neighbours, part_neighbours,
    text_graph, text_undirected, cached_graph, text_updates, text_clusters, text_adjacency, text_temporal, text_result, run_sssp, run_pagerank, run_wcc_compressed, stream_sssp,
    skeleton_cc, skeleton_php, skeleton_ppr, inc_skeleton_bfs, inc_skeleton_sssp, inc_skeleton_sswp, inc_skeleton_pagerank, mirror_sssp, mirror_inc_pagerank, mirror_node_types,
    finish_pagerank, shortcuts_reversed, shortcuts_saved, skeleton_text, position_split, first_appearance, vertex_order, generated_set,
)


# --- SQL ----------------------------------------------------------------------------------------------


def _until_sql(factors: str, start: str, step: str, tolerance: float, most: int, extra: str = "") -> str:
    """Whole-vector rounds, and the first that moves values by less than the tolerance, but by something."""
    base = c._vector_sql(factors, start, step, extra).replace("a.r < 10)", f"a.r < {most})")
    body = base[: base.rindex("SELECT id, round(value, 9)")]
    return f"""{body.rstrip()},
moved AS (SELECT r, sum(abs(value - last)) AS m FROM s WHERE r > 0 GROUP BY r), stop AS (SELECT coalesce(min(r), {most}) AS r FROM moved WHERE m > 0 AND m < {tolerance})
SELECT id, round(value, 6) AS value FROM s WHERE r = (SELECT r FROM stop)"""


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """``known`` is the SQL of the first catalog."""
    G, L, value = c.G, c.L, "round(value, 6) AS value"
    upd = G + c._applied("g")
    ppr = f"CASE WHEN id = {SOURCE} THEN {1 - FAST} / n ELSE 0 END"
    start = f"CASE WHEN id = {SOURCE} THEN 1.0 ELSE 0.0 END"
    pagerank = c._sum_sql(G, c._degree_factors("g", FAST), f"{1 - FAST} / n", 60, value)
    reset = known["reset_set"][: known["reset_set"].rindex("SELECT id FROM t")]
    lines = f"WITH {G}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS line, * FROM g)"
    cuts = c._skeleton_edges_sql()
    cuts = cuts[: cuts.index("SELECT s.entry AS src")]
    sink = ", sink AS MATERIALIZED (SELECT id FROM v WHERE id NOT IN (SELECT src FROM g))"
    spread = f"({1 - FAST} / n.n + {FAST} * (SELECT coalesce(sum(last), 0) FROM s WHERE id IN (SELECT id FROM sink)) / n.n)"
    return {
        "portion_pagerank": c._sum_sql(G, c._degree_factors("g", 0.3), "0.7 / n", 60, value), "run_pagerank": pagerank, "finish_pagerank": pagerank, "sparse_sssp": known["sssp_dist"], "rerun_sssp": known["inc_sssp"], "run_sssp": known["inc_sssp"], "stream_sssp": known["inc_sssp"],
        "reset_stats": f"{reset}SELECT (SELECT count(*) FROM t) AS n_reset, round((SELECT count(*) FROM t) / (SELECT count(*) FROM s), 9) AS share",
        "inc_ppr": c._sum_sql(upd, c._degree_factors("h", FAST), ppr, 60, value),
        "active_edges_bfs": f"SELECT hops + 1 AS round, CAST(sum(degree) AS BIGINT) AS n_edges FROM ({known['bfs_hops']}) JOIN ({known['out_degree']}) USING (id) WHERE hops < 2147483647 GROUP BY hops HAVING sum(degree) > 0",
        "tornado_php_tolerance": _until_sql(c._php_factors("g", FAST), start, f"CASE WHEN a.id = {SOURCE} THEN 1.0 ELSE 0.0 END", 1e-3, 40),
        "tornado_pagerank_tolerance": _until_sql(c._degree_factors("g", FAST), "0", spread, 1e-3, 40, sink),
        "out_neighbours": f"WITH {G} SELECT src AS id, dst AS neighbour, weight FROM g WHERE src % 97 = 0", "in_neighbours": f"WITH {G} SELECT dst AS id, src AS neighbour, weight FROM g WHERE dst % 97 = 0",
        "with_child": f"WITH {G} SELECT DISTINCT src AS id FROM g", "with_parent": f"WITH {G} SELECT DISTINCT dst AS id FROM g",
        "min_out_degree": f"WITH {G} SELECT v.id, count(g.src) AS degree FROM v LEFT JOIN g ON g.src = v.id GROUP BY v.id ORDER BY degree, v.id LIMIT 10",
        "source_parts": f"WITH {L} SELECT DISTINCT dst AS id, a AS label FROM o WHERE a <> b", "either_parts": f"WITH {L} SELECT dst AS id, a AS label FROM o WHERE a <> b UNION SELECT src, b FROM o WHERE a <> b",
        "inner_neighbours": f"WITH {L} SELECT src AS id, dst AS neighbour, weight FROM o WHERE a = b", "outer_neighbours": f"WITH {L} SELECT src AS id, dst AS neighbour, weight FROM o WHERE a <> b",
        "part_neighbours": f"WITH {L} SELECT src AS id, dst AS neighbour, weight FROM o WHERE b = 1",
        "text_graph": f"WITH {G} SELECT * FROM g", "cached_graph": f"WITH {G} SELECT * FROM g", "text_undirected": f"WITH {G} SELECT (SELECT count(*) FROM v) AS n_vertices, 2 * (SELECT count(*) FROM g) AS n_edges",
        "text_updates": known["effective_updates"], "text_clusters": f"WITH {L} SELECT id, min(id) OVER (PARTITION BY label) AS cluster FROM l", "text_adjacency": f"WITH {G} SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM g",
        "text_temporal": f"WITH {upd} SELECT 'a' AS op, src, dst, CAST(1 AS BIGINT) AS weight FROM ii UNION ALL SELECT 'd', src, dst, 1 FROM dd WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ii)",
        "text_result": f"SELECT id || ' ' || hops AS line FROM ({known['bfs_hops']})", "run_wcc_compressed": known["cc_labels"],
        "skeleton_cc": known["cc_labels"], "skeleton_php": c._sum_sql(G, c._php_factors("g", FAST), start, 60, value), "skeleton_ppr": c._sum_sql(G, c._degree_factors("g", FAST), ppr, 60, value),
        "inc_skeleton_bfs": known["inc_bfs"], "inc_skeleton_sssp": known["inc_sssp"], "inc_skeleton_sswp": known["inc_sswp"], "inc_skeleton_pagerank": known["inc_pagerank"], "mirror_inc_pagerank": known["inc_pagerank"], "mirror_sssp": known["sssp_dist"],
        "mirror_node_types": f"""WITH {L}, x AS ({c.ENDS}), m AS (SELECT DISTINCT src AS id FROM o WHERE a <> b GROUP BY b, src HAVING count(*) > 1)
SELECT x.id, CASE WHEN is_entry AND is_exit THEN 'BothOutIn' || CASE WHEN m.id IS NULL THEN '' ELSE 'Master' END WHEN is_entry THEN 'OnlyIn' WHEN is_exit THEN CASE WHEN m.id IS NULL THEN 'OnlyOut' ELSE 'OutMaster' END ELSE 'Inner' END AS node_type FROM x LEFT JOIN m ON m.id = x.id""",
        "shortcuts_reversed": f"{cuts} SELECT id AS target, entry, value AS dist FROM s", "shortcuts_saved": known["sssp_dist"], "skeleton_text": known["skeleton_edges"],
        "position_split": f"{lines}, n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.1 / 2) AS BIGINT) AS h FROM e) SELECT line, src, dst, weight, CASE WHEN line >= n - h THEN 'delete' WHEN line >= n - 2 * h THEN 'add' ELSE 'base' END AS part FROM e, n",
        "first_appearance": f"{lines}, f AS (SELECT id, row_number() OVER (ORDER BY min(p)) - 1 AS k FROM (SELECT src AS id, 2 * line AS p FROM e UNION ALL SELECT dst, 2 * line + 1 FROM e) GROUP BY id) SELECT line, a.k AS src, b.k AS dst, weight FROM e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst",
        "vertex_order": f"WITH {G}, x AS (SELECT id, min(id) OVER (PARTITION BY id % 37) AS m FROM v) SELECT id, row_number() OVER (ORDER BY m, id) - 1 AS position FROM x",
        "generated_set": "SELECT CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_lost",
    }
