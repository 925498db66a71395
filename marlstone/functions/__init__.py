"""Scalar functions on text, vectors and names."""
