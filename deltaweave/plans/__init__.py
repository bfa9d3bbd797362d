"""Algorithms put together from kernels and drivers."""
