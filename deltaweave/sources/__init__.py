"""Graphs from text files and from relational tables, and the sinks for results."""

from .graph import Graph, kept
from .tables import customer_chain, customer_updates, dense_rank_in_order, lead_in_order, supplier_part
from .text import read_clusters, read_edges, read_graph, read_matrix_market, read_adjacency, read_temporal_log, read_updates, read_vertices, write_clusters, write_edges, write_result, write_updates

__all__ = [
    "Graph", "customer_chain", "customer_updates", "dense_rank_in_order", "kept", "lead_in_order", "read_adjacency", "read_clusters", "read_edges", "read_graph",
    "read_matrix_market", "read_temporal_log", "read_updates", "read_vertices", "supplier_part", "write_clusters", "write_edges", "write_result", "write_updates",
]
