"""Joins, clustering and sparse-vector operators."""
