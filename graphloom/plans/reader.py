"""Reads as DataFrame plans.

A binding n becomes flat columns: n__id and, where the statement asks for them, n__p_<name>; a
relationship r becomes r__src, r__dst, r__rel and its properties. Patterns are equi-joins on ids, so
that Catalyst pushes filters, prunes columns and picks the joins. An optional group is planned on its
own and joined from the left with its WHERE in the join condition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.cypher.ast import Aggregate, And, Compare, Edge, Group, Literal, Node, Not, Or, Prop, Read, Sort, StartsWith, Union_
from graphloom.errors import QueryError, Unsupported
from graphloom.limits import UNBOUNDED, Limits
from graphloom.operators.reach import LAZY_HOPS, reach
from graphloom.sources.graph import PREFIX, Graph
from graphloom.storage import written

NUMBER, BOOL, TEXT = "number", "boolean", "string"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def kind_of(t: T.DataType | None) -> str | None:
    if t is None:
        return None
    return NUMBER if isinstance(t, T.NumericType) else BOOL if isinstance(t, T.BooleanType) else TEXT if isinstance(t, T.StringType) else "other"


@dataclass
class Rows:
    """Bound rows while a statement is planned."""

    df: DataFrame | None = None
    nodes: set[str] = field(default_factory=set)
    rels: set[str] = field(default_factory=set)


class Reader:
    """Plans one read over one graph snapshot."""

    def __init__(self, graph: Graph, groups: tuple[Group, ...], wanted: set[Prop], limits: Limits = UNBOUNDED):
        self.graph, self.groups, self.limits = graph, groups, limits
        self.node_vars, self.rel_vars = set(), set()
        for g in groups:
            for p in g.patterns:
                if isinstance(p, Node):
                    self.node_vars.add(p.var)
                else:
                    self.node_vars |= {p.src.var, p.dst.var}
                    if p.var:
                        self.rel_vars.add(p.var)
        both = self.node_vars & self.rel_vars
        if both:
            raise QueryError(f"{sorted(both)[0]} is a node and a relationship")
        for g in groups:
            wanted |= props_of(g.where)
        self.wanted: dict[str, set[str]] = {}
        for p in wanted:
            if p.var not in self.node_vars | self.rel_vars:
                raise QueryError(f"unbound variable {p.var}")
            if p.is_id:
                if p.var in self.rel_vars:
                    raise QueryError(f"unbound variable {p.var}: relationships have no readable id")
            else:
                self.wanted.setdefault(p.var, set()).add(p.name)

    # bound rows

    def rows(self) -> Rows:
        bound = Rows()
        for g in self.groups:
            bound = self._optional(bound, g) if g.optional else self._required(bound, g)
        return bound

    def _required(self, bound: Rows, g: Group) -> Rows:
        for p in self._ordered(list(g.patterns), bound):
            bound = self._join(bound, p, bound)
        if g.where is not None:
            bound = Rows(bound.df.filter(self.predicate(g.where)), bound.nodes, bound.rels)
        return bound

    def _optional(self, outer: Rows, g: Group) -> Rows:
        if outer.df is None:  # nothing in front: one row without bindings
            outer = Rows(self.graph.spark.range(1).select(F.lit(1).alias("#one")))
        patterns = [p for p in g.patterns if not (isinstance(p, Node) and p.var in outer.nodes and not p.constrained and p.id is None)]
        if not patterns:
            return outer
        inner = Rows()
        for p in self._ordered(patterns, inner, outer):
            inner = self._join(inner, p, outer, known=outer.nodes)
        shared = [v for v in inner.nodes if v in outer.nodes]
        df, on = inner.df, []
        for v in shared:
            df = df.withColumnRenamed(f"{v}__id", f"{v}__in")
            on.append(col(f"{v}__id") == col(f"{v}__in"))
        for r in inner.rels & outer.rels:
            df, same = self._same_relationship(df, r)
            on.append(same)
        if g.where is not None:
            on.append(self.predicate(g.where))
        drop = [c for c in df.columns if c.endswith("__in")]
        joined = outer.df.join(df, reduce(lambda a, b: a & b, on) if on else F.lit(True), "left").drop(*drop)
        return Rows(joined, outer.nodes | inner.nodes, outer.rels | inner.rels)

    def _same_relationship(self, df: DataFrame, r: str) -> tuple[DataFrame, Column]:
        parts = []
        for c in ("type", "src", "dst", "rel"):
            df = df.withColumnRenamed(f"{r}__{c}", f"{r}__{c}__in")
            parts.append(col(f"{r}__{c}").eqNullSafe(col(f"{r}__{c}__in")))
        repeated = [c for c in df.columns if c.startswith(f"{r}__{PREFIX}")]
        return df.drop(*repeated), reduce(lambda a, b: a & b, parts)

    def _ordered(self, patterns: list[Node | Edge], bound: Rows, outer: Rows | None = None) -> list[Node | Edge]:
        """Greedy: connected before unconnected, then the more selective access, then as written."""
        seen = set(bound.nodes)
        given = seen | (outer.nodes if outer else set())
        left, out = list(patterns), []
        while left:

            def rank(p: Node | Edge) -> tuple:
                ends = [p] if isinstance(p, Node) else [p.src, p.dst]
                if isinstance(p, Edge) and p.hops and p.src.id is None and p.src.var not in given:
                    return (2, 0)
                connected = not seen or any(n.var in seen for n in ends)
                access = 0 if any(n.id is not None for n in ends) else 1 if any(n.props for n in ends) or isinstance(p, Edge) and p.props else 2 if any(n.labels for n in ends) else 3
                return (0 if connected else 1, 4 if isinstance(p, Edge) and p.hops else access)

            best = min(left, key=rank)
            left.remove(best)
            out.append(best)
            ends = {best.var} if isinstance(best, Node) else {best.src.var, best.dst.var}
            seen |= ends
            given |= ends
        return out

    def _join(self, bound: Rows, p: Node | Edge, seeds: Rows, known: set[str] = frozenset()) -> Rows:
        """known: nodes whose properties other rows already carry."""
        if isinstance(p, Node):
            return self._join_node(bound, p, known)
        has = bound.nodes | set(known)
        if p.hops:
            frame = self._reach_frame(bound if p.src.var in bound.nodes else seeds, p)
        else:
            frame = self._edge_frame(p)
        for n in (p.src, p.dst) if p.src.var != p.dst.var else (p.src,):
            frame = self._attach(frame, n, hydrate=n.var not in has)
        nodes, rels = bound.nodes | {p.src.var, p.dst.var}, bound.rels | ({p.var} if p.var else set())
        if bound.df is None:
            return Rows(frame, nodes, rels)
        on = []
        for v in dict.fromkeys((p.src.var, p.dst.var)):
            if v in bound.nodes:
                frame = frame.withColumnRenamed(f"{v}__id", f"{v}__in")
                on.append(col(f"{v}__id") == col(f"{v}__in"))
        if p.var and p.var in bound.rels:
            frame, same = self._same_relationship(frame, p.var)
            on.append(same)
        drop = [c for c in frame.columns if c.endswith("__in")]
        df = bound.df.join(frame, reduce(lambda a, b: a & b, on), "inner") if on else bound.df.crossJoin(frame)
        return Rows(df.drop(*drop), nodes, rels)

    def _join_node(self, bound: Rows, p: Node, known: set[str]) -> Rows:
        if p.var in bound.nodes:
            df = bound.df.filter(col(f"{p.var}__id").isNotNull())
            if p.id is not None:
                df = df.filter(col(f"{p.var}__id") == F.lit(p.id))
            return Rows(self._attach(df, p, hydrate=False, by_id=False), bound.nodes, bound.rels)
        hydrate = p.var not in known
        if p.id is not None and not p.constrained:
            # a seek yields its id whether or not there is such a vertex
            frame = self.graph.spark.range(1).select(F.lit(p.id).cast("long").alias(f"{p.var}__id"))
            frame = self._attach(frame, p, hydrate)
        elif p.constrained or p.id is not None:
            frame = self._vertices(p, hydrate)
        else:
            raise Unsupported(f"({p.var}) needs an id, a label or a property")
        df = frame if bound.df is None else bound.df.crossJoin(frame)
        return Rows(df, bound.nodes | {p.var}, bound.rels)

    def _vertices(self, n: Node, hydrate: bool) -> DataFrame:
        """Vertices that fit a node pattern, with the properties that the statement reads."""
        df = self.graph.labelled(n.labels)
        if n.id is not None:
            df = df.filter(F.col("id") == F.lit(n.id))
        for name, value in n.props:
            df = df.filter(self.equals(self.graph.vertex_type(name), F.col(PREFIX + name) if self.graph.vertex_type(name) else None, value))
        return df.select(F.col("id").alias(f"{n.var}__id"), *self._props(n.var, self.graph.vertices, hydrate))

    def _props(self, var: str, df: DataFrame, hydrate: bool) -> list[Column]:
        if not hydrate:
            return []
        return [F.col(PREFIX + k).alias(f"{var}__{PREFIX}{k}") for k in sorted(self.wanted.get(var, ())) if PREFIX + k in df.columns]

    def _attach(self, frame: DataFrame, n: Node, hydrate: bool, by_id: bool = True) -> DataFrame:
        """Keep the rows whose node fits the pattern, and add its properties."""
        if by_id and n.id is not None:
            frame = frame.filter(col(f"{n.var}__id") == F.lit(n.id))
        props = self._props(n.var, self.graph.vertices, hydrate)
        if not n.constrained and not props:
            return frame
        if n.constrained:
            v, how = self._vertices(n, hydrate), "inner" if props else "left_semi"
        else:
            v, how = self.graph.vertices.select(F.col("id").alias(f"{n.var}__id"), *props), "left"
        v = v.withColumnRenamed(f"{n.var}__id", f"{n.var}__v")
        return frame.join(v, col(f"{n.var}__id") == col(f"{n.var}__v"), how).drop(f"{n.var}__v")

    def _edge_frame(self, p: Edge) -> DataFrame:
        df = self.graph.of_type(p.type)
        for name, value in p.props:
            t = self.graph.relationship_type(name)
            df = df.filter(self.equals(t, F.col(PREFIX + name) if t else None, value))
        if p.src.id is not None:
            df = df.filter(F.col("src") == F.lit(p.src.id))
        if p.dst.id is not None:
            df = df.filter(F.col("dst") == F.lit(p.dst.id))
        if p.src.var == p.dst.var:
            df = df.filter("src = dst")
        out = [F.col("src").alias(f"{p.src.var}__id")]
        if p.src.var != p.dst.var:
            out.append(F.col("dst").alias(f"{p.dst.var}__id"))
        if p.var:
            out += [F.col("edge_type").alias(f"{p.var}__type"), F.col("src").alias(f"{p.var}__src"), F.col("dst").alias(f"{p.var}__dst"), F.col("rel_id").alias(f"{p.var}__rel")]
            out += self._props(p.var, self.graph.relationships, True)
        return df.select(*out)

    def _reach_frame(self, seeds: Rows, p: Edge) -> DataFrame:
        if p.src.id is not None:
            starts = self.graph.spark.range(1).select(F.lit(p.src.id).cast("long").alias("origin"))
        elif p.src.var in seeds.nodes and seeds.df is not None:
            starts = seeds.df.select(col(f"{p.src.var}__id").alias("origin")).filter("origin is not null").distinct()
        else:
            raise Unsupported("a variable length needs a source with an id or bound before")
        pairs = self._reached(p, starts)
        if p.src.var == p.dst.var:
            return pairs.filter("origin = v").select(F.col("origin").alias(f"{p.src.var}__id"))
        return pairs.select(F.col("origin").alias(f"{p.src.var}__id"), F.col("v").alias(f"{p.dst.var}__id"))

    def _reached(self, p: Edge, starts: DataFrame) -> DataFrame:
        find = lambda: reach(self.graph.adjacency(p.type), starts, *p.hops, self.limits)
        if p.src.id is None or p.hops[1] <= LAZY_HOPS:
            return find()
        key = (p.type, p.src.id, *p.hops)
        if key not in self.graph.reached:
            self.graph.reached[key] = written(find(), "reached")
        return self.graph.reached[key]

    # expressions

    def type_of(self, o: Prop | Literal) -> T.DataType | None:
        if isinstance(o, Literal):
            v = o.value
            return T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
        if o.is_id:
            return T.LongType()
        return self.graph.vertex_type(o.name) if o.var in self.node_vars else self.graph.relationship_type(o.name)

    def value(self, o: Prop | Literal) -> Column:
        if isinstance(o, Literal):
            return F.lit(o.value)
        if o.is_id:
            return col(f"{o.var}__id")
        return col(f"{o.var}__{PREFIX}{o.name}") if self.type_of(o) is not None else F.lit(None)

    def equals(self, t: T.DataType | None, c: Column | None, value: object) -> Column:
        if c is None or kind_of(t) != kind_of(self.type_of(Literal(value))):
            return F.lit(False)
        return _same_number(t, c, self.type_of(Literal(value)), F.lit(value), value)

    def compare(self, p: Compare) -> Column:
        lt, rt = self.type_of(p.left), self.type_of(p.right)
        if lt is None or rt is None:  # a property that nothing has
            return F.lit(False)
        lk, rk = kind_of(lt), kind_of(rt)
        left, right = self.value(p.left), self.value(p.right)
        if p.op in ("=", "<>"):
            if lk != rk:
                return F.lit(False) if p.op == "=" else left.isNotNull() & right.isNotNull()
            same = _same_number(lt, left, rt, right, p.right.value if isinstance(p.right, Literal) else p.left.value if isinstance(p.left, Literal) else None)
            return same if p.op == "=" else ~same
        if lk != rk or lk == BOOL:
            raise QueryError(f"{lk} and {rk} have no order")
        return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[p.op]

    def predicate(self, p: object, negated: bool = False) -> Column:
        """Two-valued: what compares with a missing value is false. Only below NOT does that need a coalesce;
        elsewhere NULL is dropped by the filter anyway, and the bare predicate can be pushed to the scan."""
        if isinstance(p, And):
            return self.predicate(p.left, negated) & self.predicate(p.right, negated)
        if isinstance(p, Or):
            return self.predicate(p.left, negated) | self.predicate(p.right, negated)
        if isinstance(p, Not):
            return ~self.predicate(p.of, True)
        if isinstance(p, StartsWith):
            text = kind_of(self.type_of(p.left)) == TEXT
            c = F.startswith(self.value(p.left), F.lit(p.prefix)) if text else F.lit(False)
        else:
            c = self.compare(p)
        return F.coalesce(c, F.lit(False)) if negated else c


def _same_number(lt: T.DataType, left: Column, rt: T.DataType, right: Column, literal: object = None) -> Column:
    """Equality; between a whole number and a float only if the float is exactly that number."""
    ints = [isinstance(t, T.IntegralType) for t in (lt, rt)]
    if kind_of(lt) != NUMBER or ints[0] == ints[1]:
        return left == right
    whole, real = (left, right) if ints[0] else (right, left)
    if isinstance(literal, float):
        if literal != literal or not literal.is_integer() or abs(literal) >= 2.0**63:
            return F.lit(False) & whole.isNotNull()
        return (left if ints[0] else right) == F.lit(int(literal))
    if isinstance(literal, int) and not isinstance(literal, bool):
        return real == F.lit(float(literal)) if float(literal) == literal else F.lit(False) & real.isNotNull()
    return (whole.cast("double") == real) & (whole.cast("double").try_cast("long") == whole)


def props_of(p: object) -> set[Prop]:
    if p is None or isinstance(p, (Literal, str)):
        return set()
    if isinstance(p, Prop):
        return {p}
    if isinstance(p, Aggregate):
        return props_of(p.of)
    if isinstance(p, Not):
        return props_of(p.of)
    if isinstance(p, StartsWith):
        return props_of(p.left)
    return props_of(p.left) | props_of(p.right)


def plan(graph: Graph, statement: Read | Union_, limits: Limits = UNBOUNDED) -> DataFrame:
    if isinstance(statement, Read):
        return plan_read(graph, statement, limits)
    arms = [plan_read(graph, a, limits) for a in statement.arms]  # each keeps its own order and window
    out = reduce(lambda a, b: a.unionByName(b), arms)
    return out if statement.all else out.distinct()


def plan_read(graph: Graph, q: Read, limits: Limits = UNBOUNDED) -> DataFrame:
    wanted = set().union(*(props_of(i.of) for i in q.items), *(props_of(s.of) for s in q.order))
    r = Reader(graph, q.groups, wanted, limits)
    bound = r.rows()
    keys = [i for i in q.items if isinstance(i.of, Prop)]
    sums = [i for i in q.items if isinstance(i.of, Aggregate)]
    hidden: list[str] = []
    if sums:
        aggs = [aggregate(r, i.of).alias(i.name) for i in sums]
        df = bound.df.groupBy(*[_typed(r, i.of).alias(i.name) for i in keys]).agg(*aggs) if keys else bound.df.agg(*aggs)
        df = df.select(*[col(i.name) for i in q.items])
    else:
        extra = []
        for n, s in enumerate(q.order):
            if isinstance(s.of, Prop) and not any(i.of == s.of for i in q.items):
                hidden.append(f"#sort{n}")
                extra.append(_typed(r, s.of).alias(hidden[-1]))
        df = bound.df.select(*[_typed(r, i.of).alias(i.name) for i in q.items], *extra)
    if q.distinct:
        df = df.distinct()
    if q.order:
        df = df.orderBy(*[_sort(q, n, s, hidden) for n, s in enumerate(q.order)])
    if q.skip:
        df = df.offset(q.skip)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.drop(*hidden) if hidden else df


def _typed(r: Reader, o: Prop) -> Column:
    return r.value(o) if r.type_of(o) is not None else F.lit(None).cast("string")


def _sort(q: Read, n: int, s: Sort, hidden: list[str]) -> Column:
    """NULL is the largest value: last in ascending order, first in descending."""
    name = s.of if isinstance(s.of, str) else f"#sort{n}" if f"#sort{n}" in hidden else next(i.name for i in q.items if i.of == s.of)
    return col(name).asc_nulls_last() if s.ascending else col(name).desc_nulls_first()


def aggregate(r: Reader, a: Aggregate) -> Column:
    if a.of is None:
        return F.count("*")
    t, c = r.type_of(a.of), r.value(a.of)
    if a.fn == "count":
        return F.count(c)
    if a.fn == "collect":
        return F.collect_list(c if t is not None else c.cast("string"))
    if t is None:
        return F.lit(0).cast("long") if a.fn == "sum" else F.lit(None).cast("double")
    if not isinstance(t, T.IntegralType):
        raise QueryError(f"{a.fn} takes whole numbers that are not negative")
    c = F.when(c < 0, F.raise_error(F.lit(f"{a.fn} takes numbers that are not negative"))).otherwise(c)
    if a.fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return F.sum(c).cast("double") / F.count(c)
