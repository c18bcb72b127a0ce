"""Readers and generators of corpora."""
