"""Whole workflows composed of operators and kernels."""
