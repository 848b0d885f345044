"""Scalar functions over boards: native column expressions, and numpy kernels for what branches per row."""
