"""Scalar functions: Column expressions, and plain Python helpers for kernels and rendering."""
