"""Scalar functions: text, vectors and memory arithmetic, all as Column expressions."""
