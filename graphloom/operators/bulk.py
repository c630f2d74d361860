"""Programmatic writes of whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import Conflict, QueryError
from graphloom.operators.mutate import EDGE, Result, append_relationships, delete_vertices, merge_vertices, next_id, upsert_relationships
from graphloom.sources.graph import PREFIX, Graph

__all__ = ["append_edges_trusted", "delete_edges", "delete_relationships", "delete_vertices", "drop_type", "import_edges", "import_relationships", "import_vertices", "ingest", "merge_vertices", "upsert_relationships"]


def import_edges(g: Graph, edges: DataFrame, check: bool = True) -> tuple[Graph, Result]:
    """Bare edges from edges(edge_type, src, dst): those that exist are left alone; check refuses repeats in the input."""
    wanted = edges.select(*EDGE)
    n = wanted.count()
    distinct = wanted.distinct()
    if check and distinct.count() < n:
        raise Conflict("the input repeats an edge")
    new = distinct.join(g.relationships.select(*EDGE).distinct(), EDGE, "left_anti")
    created = new.count()
    return append_relationships(g, new), Result(created=created, noops=n - created)


def append_edges_trusted(g: Graph, edges: DataFrame) -> Graph:
    """Bare edges that the caller knows to be new and distinct; nothing is compared."""
    return append_relationships(g, edges.select(*EDGE, *[c for c in edges.columns if c.startswith(PREFIX)]))


def import_relationships(g: Graph, new: DataFrame) -> tuple[Graph, Result]:
    """Relationships with fresh ids from new(edge_type, src, dst, p_* ...)."""
    first = next_id(g)
    # ids need only be distinct and new: they leave gaps, and no row has to wait for another partition
    numbered = new.withColumn("rel_id", F.monotonically_increasing_id() + F.lit(first))
    return append_relationships(g, numbered), Result(created=new.count())


def import_vertices(g: Graph, new: DataFrame) -> tuple[Graph, Result]:
    """Upsert vertices from new(id, labels, p_* ...), one row per id."""
    if new.groupBy("id").count().filter("count > 1").limit(1).count():
        raise QueryError("the input repeats an id")
    return merge_vertices(g, new)


def delete_edges(g: Graph, edges: DataFrame) -> tuple[Graph, Result]:
    """Edges (edge_type, src, dst) with all of their relationships."""
    t = edges.select(*EDGE).distinct()
    n = g.relationships.join(t, EDGE, "left_semi").count()
    return g.replaced(relationships=g.relationships.join(t, EDGE, "left_anti").select(*g.relationships.columns)), Result(deleted=n)


def delete_relationships(g: Graph, keys: DataFrame) -> tuple[Graph, Result]:
    """Relationships (edge_type, src, dst, rel_id)."""
    on = [*EDGE, "rel_id"]
    t = keys.select(*on).distinct()
    n = g.relationships.join(t, on, "left_semi").count()
    return g.replaced(relationships=g.relationships.join(t, on, "left_anti").select(*g.relationships.columns)), Result(deleted=n)


def drop_type(g: Graph, edge_type: str) -> Graph:
    return g.replaced(relationships=g.relationships.filter(F.col("edge_type") != edge_type))


def ingest(g: Graph, changes: DataFrame) -> Graph:
    """Apply changes(op, seq, edge_type, src, dst): the last `put` or `delete` of each bare edge holds."""
    last = changes.groupBy(*EDGE).agg(F.max_by("op", "seq").alias("op"))
    put, gone = last.filter("op = 'put'").select(*EDGE), last.filter("op = 'delete'").select(*EDGE)
    left = g.relationships.join(gone, EDGE, "left_anti").select(*g.relationships.columns)
    kept = g.replaced(relationships=left)
    return append_relationships(kept, put.join(left.select(*EDGE).distinct(), EDGE, "left_anti"))
