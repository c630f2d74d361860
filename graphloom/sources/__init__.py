"""Graphs and where they come from."""
