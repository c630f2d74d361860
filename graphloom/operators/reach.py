"""Bounded reachability by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.limits import UNBOUNDED, Limits
from graphloom.storage import written, written_by

#: Hops planned lazily in one plan; longer ranges write each frontier to the shared folder.
LAZY_HOPS = 3


def reach(adjacency: DataFrame, starts: DataFrame, low: int, high: int, limits: Limits = UNBOUNDED) -> DataFrame:
    """(origin, v): the ends of walks of low to high hops over adjacency(src, dst) from starts(origin).

    Walks may repeat vertices, so the origin and vertices nearer by come back where a walk of the
    right length ends there. Each hop keeps a vertex once per origin; zero hops end at the origin.
    """
    frontier = starts.select("origin", F.col("origin").alias("v"))
    parts = [frontier] if low == 0 else []
    adj = adjacency.select(F.col("src").alias("v"), F.col("dst").alias("next"))
    eager = high > LAZY_HOPS
    if high > 2:  # read at every hop, and moved to its place once
        adj = written_by(adj, "adjacency", "v")
    for hop in range(1, high + 1):
        frontier = frontier.join(adj, "v").select("origin", F.col("next").alias("v")).distinct()
        if eager:
            frontier = written(frontier, "frontier")
            limits.check_rows(frontier)
            if frontier.isEmpty():
                break
        if hop >= low:
            parts.append(frontier)
    if not parts:
        return frontier
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct() if len(parts) > 1 else out


def bfs(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(v): vertices first seen within `hops` hops of any start; the starts themselves are left out."""
    seen = starts.select(F.col(starts.columns[0]).alias("v")).distinct()
    first = seen
    frontier = seen
    adj = written_by(edges.select(F.col("src").alias("v"), F.col("dst").alias("next")).distinct(), "adjacency", "v")
    for _ in range(hops):
        frontier = written(frontier.join(adj, "v").select(F.col("next").alias("v")).distinct().join(seen, "v", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)  # a union of written tables
    return seen.join(first, "v", "left_anti")
