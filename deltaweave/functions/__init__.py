"""Kernels: the algorithms' formulas as Column expressions."""

from .kernels import BFS, CC, SSSP, SSWP, SelectKernel, SumKernel, pagerank_kernel, personalised_pagerank_kernel, php_kernel

__all__ = ["BFS", "CC", "SSSP", "SSWP", "SelectKernel", "SumKernel", "pagerank_kernel", "personalised_pagerank_kernel", "php_kernel"]
