"""Scalar functions and Arrow kernels."""
