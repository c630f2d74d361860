"""Cardinalities and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.graph import PREFIX, Graph
from graphloom.storage import read_text


def edge_type_counts(g: Graph) -> DataFrame:
    """(edge_type, relationships, edges): records, and distinct (type, src, dst)."""
    per = g.relationships.groupBy("edge_type", "src", "dst").agg(F.count("*").alias("n"))
    return per.groupBy("edge_type").agg(F.sum("n").alias("relationships"), F.count("*").alias("edges"))


def label_counts(g: Graph) -> DataFrame:
    return g.vertices.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("vertices"))


def property_counts(g: Graph) -> DataFrame:
    """(property, vertices): how many vertices have each property."""
    return _property_counts(g.vertices, "vertices")


def relationship_property_counts(g: Graph) -> DataFrame:
    return _property_counts(g.relationships, "relationships")


def _property_counts(df: DataFrame, name: str) -> DataFrame:
    props = [c for c in df.columns if c.startswith(PREFIX)]
    if not props:
        return df.sparkSession.createDataFrame([], f"property string, {name} long")
    one = df.agg(*[F.count(c).alias(c) for c in props])
    pairs = F.array(*[F.struct(F.lit(c.removeprefix(PREFIX)).alias("property"), F.col(c).alias(name)) for c in props])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def vertex_histogram(g: Graph, prop: str, label: str | None = None) -> DataFrame:
    """(value, n) of a vertex property, most common first is for the caller to order."""
    v = g.vertices if label is None else g.vertices.filter(F.array_contains("labels", label))
    return v.filter(F.col(PREFIX + prop).isNotNull()).groupBy(F.col(PREFIX + prop).alias("value")).agg(F.count("*").alias("n"))


def edge_histogram(g: Graph, edge_type: str, prop: str) -> DataFrame:
    r = g.of_type(edge_type)
    return r.filter(F.col(PREFIX + prop).isNotNull()).groupBy(F.col(PREFIX + prop).alias("value")).agg(F.count("*").alias("n"))


def collected(g: Graph) -> DataFrame:
    """(kind, name, n): relationships by type, vertices by label, and how many of them have each property."""
    parts = [
        edge_type_counts(g).select(F.lit("edge_type").alias("kind"), F.col("edge_type").alias("name"), F.col("relationships").alias("n")),
        label_counts(g).select(F.lit("label"), "label", "vertices"),
        property_counts(g).select(F.lit("vertex_property"), "property", "vertices"),
        relationship_property_counts(g).select(F.lit("relationship_property"), "property", "relationships"),
    ]
    return reduce(lambda a, b: a.unionAll(b), parts)


def refresh(g: Graph, path: str) -> DataFrame:
    """The statistics of this snapshot from the folder, where they are collected once for each version."""
    where = f"{path.rstrip('/')}/stats-v{g.version}"
    if read_text(g.spark, f"{where}/_SUCCESS") is None:
        collected(g).write.mode("overwrite").parquet(where)
    return g.spark.read.parquet(where)


def summary(histogram: DataFrame) -> DataFrame:
    """(total, distinct_values, most_common) of a histogram."""
    return histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_values"), F.coalesce(F.max("n"), F.lit(0)).alias("most_common"))
