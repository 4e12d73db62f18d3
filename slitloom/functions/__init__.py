"""Scalar functions as column expressions, and numeric kernels in NumPy."""
