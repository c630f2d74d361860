"""Point and batch reads of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cypher.ast import Batch
from graphloom.errors import QueryError
from graphloom.sources.graph import Graph


def edge_exists(g: Graph, edge_type: str, src: int, dst: int) -> bool:
    return not g.of_type(edge_type).filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def out_neighbors(g: Graph, edge_type: str, src: int) -> DataFrame:
    """(id): distinct destinations in order."""
    return g.of_type(edge_type).filter(F.col("src") == src).select(F.col("dst").alias("id")).distinct().orderBy("id")


def in_neighbors(g: Graph, edge_type: str, dst: int) -> DataFrame:
    return g.of_type(edge_type).filter(F.col("dst") == dst).select(F.col("src").alias("id")).distinct().orderBy("id")


def out_degree(g: Graph, edge_type: str, src: int) -> DataFrame:
    """(degree): distinct destinations."""
    return g.of_type(edge_type).filter(F.col("src") == src).agg(F.countDistinct("dst").alias("degree"))


def degrees(g: Graph, edge_type: str) -> DataFrame:
    """(id, degree) of every vertex with outgoing edges."""
    return g.adjacency(edge_type).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def _batch(g: Graph, edge_type: str, wanted: DataFrame, near: str, far: str) -> DataFrame:
    r = g.of_type(edge_type).select(F.col(near).alias("near"), F.col(far).alias("far"))
    # the wanted ids cut the relationships down before neighbours are gathered
    found = r.join(wanted.select(F.col("id").alias("near")).distinct(), "near", "left_semi").groupBy("near").agg(F.sort_array(F.collect_set("far")).alias("neighbors"))
    out = wanted.join(found, wanted["id"] == found["near"], "left")
    return out.select(*wanted.columns, F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def out_neighbors_batch(g: Graph, edge_type: str, wanted: DataFrame) -> DataFrame:
    """wanted(id, ...) with sorted unique out-neighbours; input rows stay as they are, repeats too."""
    return _batch(g, edge_type, wanted, "src", "dst")


def in_neighbors_batch(g: Graph, edge_type: str, wanted: DataFrame) -> DataFrame:
    return _batch(g, edge_type, wanted, "dst", "src")


def edge_exists_batch(g: Graph, edge_type: str, wanted: DataFrame) -> DataFrame:
    """wanted(src, dst, ...) with `exists`."""
    found = g.adjacency(edge_type).withColumn("exists", F.lit(True))
    return wanted.join(found, ["src", "dst"], "left").select(*wanted.columns, F.coalesce("exists", F.lit(False)).alias("exists"))


def batch_rows(g: Graph, rows: tuple[dict, ...], fields: dict[str, str]) -> DataFrame:
    """Batch rows with an ordinal: fields maps row field to column type (long where it names an id)."""
    data = []
    for n, row in enumerate(rows):
        values = []
        for f, t in fields.items():
            if f not in row:
                raise QueryError(f"row {n} has no field {f}")
            x = row[f]
            if t == "bigint" and (isinstance(x, bool) or not isinstance(x, int) or x < 0):
                raise QueryError(f"field {f} of row {n} must be an id")
            values.append(x)
        data.append((n, *values))
    return g.spark.createDataFrame(data, ", ".join(["`#n` bigint", *(f"`{f}` {t}" for f, t in fields.items())]))


def batch_out_neighbors(g: Graph, b: Batch) -> DataFrame:
    name = b.edge.src.id.name
    wanted = batch_rows(g, b.rows, {name: "bigint"}).select("#n", F.col(f"`{name}`").alias("id"))
    out = out_neighbors_batch(g, b.edge.type, wanted)
    return out.select(F.col("id").alias(b.columns[0]), F.explode("neighbors").alias(b.columns[1]))
