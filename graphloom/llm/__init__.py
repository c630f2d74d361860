"""Operators for building training corpora at scale, each on plain DataFrames."""
