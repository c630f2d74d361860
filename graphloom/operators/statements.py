"""Statements built in Python instead of text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cypher.ast import And, Compare, CreateEdges, Edge, Group, Item, Literal, Node, Prop, Read
from graphloom.engine import Engine
from graphloom.errors import QueryError
from graphloom.operators import points
from graphloom.operators.mutate import Result, apply
from graphloom.operators.reach import reach
from graphloom.plans.reader import plan


@dataclass(frozen=True)
class CreateEdge:
    edge_type: str
    src: int
    dst: int
    src_labels: tuple[str, ...] = ()
    dst_labels: tuple[str, ...] = ()
    src_props: tuple[tuple[str, object], ...] = ()
    dst_props: tuple[tuple[str, object], ...] = ()
    props: tuple[tuple[str, object], ...] = ()

    def run(self, e: Engine) -> Result:
        edge = Edge(Node("a", self.src_labels, self.src, self.src_props), Node("b", self.dst_labels, self.dst, self.dst_props), self.edge_type, None, self.props)
        e.graph, result = apply(e.graph, CreateEdges((edge,)))
        return result


@dataclass(frozen=True)
class MatchOut:
    """Out-neighbours of a vertex; or with return_count, how many there are."""

    edge_type: str
    src: int
    return_count: bool = False

    def run(self, e: Engine) -> DataFrame:
        return points.out_degree(e.graph, self.edge_type, self.src) if self.return_count else points.out_neighbors(e.graph, self.edge_type, self.src)


@dataclass(frozen=True)
class MatchOutFiltered:
    """Out-neighbours with labels and properties."""

    edge_type: str
    src: int
    labels: tuple[str, ...] = ()
    where: tuple[tuple[str, str, object], ...] = ()  # property, operator, value

    def run(self, e: Engine) -> DataFrame:
        predicate = None
        for name, op, value in self.where:
            c = Compare(op, Prop("b", name), Literal(value))
            predicate = c if predicate is None else And(predicate, c)
        pattern = Edge(Node("a", (), self.src), Node("b", self.labels), self.edge_type)
        return plan(e.graph, Read((Group((pattern,), predicate),), (Item(Prop("b", "id"), "id"),), distinct=True))


@dataclass(frozen=True)
class MatchEdge:
    edge_type: str
    src: int
    dst: int

    def run(self, e: Engine) -> bool:
        return points.edge_exists(e.graph, self.edge_type, self.src, self.dst)


@dataclass(frozen=True)
class MatchReachable:
    edge_type: str
    src: int
    low: int
    high: int
    return_count: bool = False

    def run(self, e: Engine) -> DataFrame:
        if not 0 <= self.low <= self.high:
            raise QueryError("the range of hops is empty")
        e.limits.check("hops", self.high)
        starts = e.graph.spark.range(1).select(F.lit(self.src).cast("long").alias("origin"))
        out = reach(e.graph.adjacency(self.edge_type), starts, self.low, self.high, e.limits).select(F.col("v").alias("id"))
        return out.agg(F.count("*").alias("count")) if self.return_count else out
