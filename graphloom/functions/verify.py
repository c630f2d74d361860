"""Digests and consistency checks of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from graphloom.sources.graph import Graph


def digest(g: Graph) -> dict[str, int]:
    """Counts and order-free checksums of edges, out-degrees and in-degrees."""
    e = g.edges()
    out = {}
    for name, df, cols in (
        ("edges", e, ("edge_type", "src", "dst")),
        ("out_degrees", e.groupBy("edge_type", "src").agg(F.count("*").alias("n")), ("edge_type", "src", "n")),
        ("in_degrees", e.groupBy("edge_type", "dst").agg(F.count("*").alias("n")), ("edge_type", "dst", "n")),
    ):
        row = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0))).first()
        out[name], out[f"{name}_checksum"] = row[0], row[1]
    return out


@dataclass(frozen=True)
class Report:
    duplicate_vertices: int
    duplicate_relationships: int
    bare_duplicates: int
    out_of_range_ids: int
    null_keys: int
    uneven_types: int  # types whose edges, walked from sources and from destinations, are not as many
    endpoints_without_vertex: int  # allowed, for information

    @property
    def ok(self) -> bool:
        return not (self.duplicate_vertices or self.duplicate_relationships or self.bare_duplicates or self.out_of_range_ids or self.null_keys or self.uneven_types)


def verify(g: Graph) -> Report:
    v, r = g.vertices, g.relationships
    twice = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1").count()
    walked = lambda near, name: g.edges().groupBy("edge_type", near).agg(F.count("*").alias("n")).groupBy("edge_type").agg(F.sum("n").alias(name))
    uneven = walked("src", "out").join(walked("dst", "in"), "edge_type", "full").filter("not (out <=> `in`)")
    ends = r.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Report(
        twice(v, "id"),
        twice(r.filter("rel_id is not null"), "edge_type", "src", "dst", "rel_id"),
        twice(r.filter("rel_id is null"), "edge_type", "src", "dst"),
        v.filter("id < 0").count() + r.filter("src < 0 or dst < 0").count(),
        v.filter("id is null or labels is null").count() + r.filter("edge_type is null or src is null or dst is null").count(),
        uneven.count(),
        ends.join(v.select("id"), "id", "left_anti").count(),
    )
