"""Registered queries against their SQL on the smallest tables; the slow pairs run in the driver's comparison."""

import pytest

import __spark_entry__
from deltaweave import catalog

from .oracle import duck, same_rows

QUICK = (
    "bfs_hops", "sswp_width", "cc_bipartite", "php_delta_10", "php_10", "gcn_layer", "out_degree", "top_out_degree", "graph_counts", "undirected_edges_keep", "border_vertices", "apply_updates", "effective_updates",
    "inc_sssp", "reset_set", "cluster_benefit", "mirror_choice", "node_types", "compression_stats", "skeleton_edges", "split_updates", "reweight", "enlarge", "relabel", "result_diff",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sf_dir, con, name):
    same_rows(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])


def test_registry(spark):
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 150
