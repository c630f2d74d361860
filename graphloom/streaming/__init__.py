"""Feeding a graph from streams of changes."""
