"""Traversal, paths and writes."""
