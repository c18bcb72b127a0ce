"""Scalar similarity: kernels, Spark functions and their SQL names."""
