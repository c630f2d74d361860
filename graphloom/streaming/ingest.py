"""Continual ingestion: a stream of edge changes becomes a sequence of graph snapshots.

Not a query feature: reads always see one snapshot. Each micro-batch is applied with bulk.ingest and
saved as the next version; a batch that is delivered again after a failure finds its version saved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.errors import QueryError
from graphloom.functions.stats import refresh
from graphloom.operators.bulk import ingest
from graphloom.sources.graph import Graph, load


def ingest_stream(changes: DataFrame, path: str, checkpoint: str, first: Graph, statistics: bool = False) -> StreamingQuery:
    """Apply a stream of (op, seq, edge_type, src, dst) to the snapshots under path; `first` is saved as version 0.

    With statistics, those of each new version are collected beside it.
    """
    spark = changes.sparkSession

    def saved(version: int) -> Graph | None:
        try:
            return load(spark, path, version)
        except QueryError:
            return None

    if saved(0) is None:
        Graph(first.vertices, first.relationships, 0).save(path)

    def apply(batch: DataFrame, n: int) -> None:
        if saved(n + 1) is None:
            g = ingest(load(spark, path, n), batch)
            Graph(g.vertices, g.relationships, n + 1).save(path)
        if statistics:
            refresh(load(spark, path, n + 1), path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
