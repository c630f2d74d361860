"""The entry point: statements over graph snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.cypher.ast import Batch, Edge, PathCall, Read, Union_, is_write
from graphloom.cypher.parser import parse
from graphloom.errors import LimitExceeded, QueryError
from graphloom.limits import Limits
from graphloom.operators.mutate import Ledger, Result, apply
from graphloom.operators.paths import run_paths
from graphloom.operators.points import batch_out_neighbors
from graphloom.plans.reader import plan
from graphloom.sources.graph import Graph
from graphloom.storage import written


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    columns: list[str]
    next_cursor: str | None


@dataclass
class Engine:
    """Runs statements on the current snapshot; a write puts a new snapshot in its place.

    read() is lazy and bounded by hops, edges and intermediate rows only; rows(), value() and page()
    collect under all limits. max_hops and max_rows set these two limits alone.
    """

    graph: Graph
    max_hops: int | None = None
    max_rows: int | None = None
    ledger: Ledger = field(default_factory=Ledger)
    limits: Limits = field(default_factory=Limits)
    _pages: dict[str, tuple[int, DataFrame, list[str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_hops is not None:
            self.limits = replace(self.limits, hops=self.max_hops)
        if self.max_rows is not None:
            self.limits = replace(self.limits, rows=self.max_rows)
        self.max_hops = self.limits.hops

    def read(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """The lazy result of a read on the snapshot of this moment."""
        s = parse(text, params, self.limits.hops)
        if is_write(s):
            raise QueryError("this statement writes; use write()")
        self._check_edges(s)
        if isinstance(s, PathCall):
            return run_paths(self.graph, s, self.limits, self.max_rows)
        if isinstance(s, Batch):
            return batch_out_neighbors(self.graph, s)
        assert isinstance(s, (Read, Union_))
        if self.max_rows is not None:
            for arm in s.arms if isinstance(s, Union_) else (s,):
                if (arm.limit or 0) > self.max_rows:
                    raise LimitExceeded(f"LIMIT {arm.limit} is over {self.max_rows} rows")
        return plan(self.graph, s, self.limits)

    def _check_edges(self, s: object) -> None:
        if self.limits.edges is None:
            return
        types = {p.type for arm in (s.arms if isinstance(s, Union_) else (s,)) if isinstance(arm, Read) for g in arm.groups for p in g.patterns if isinstance(p, Edge)}
        types |= set(s.config.get("relTypes") or ()) if isinstance(s, PathCall) else {s.edge.type} if isinstance(s, Batch) else set()
        if types:
            self.limits.check("edges", self.graph.relationships.filter(F.col("edge_type").isin(*types)).count())

    def rows(self, text: str, params: Mapping[str, object] | None = None) -> list[Row]:
        """The collected result, under the limits of rows and seconds; arms of a union count each, too."""
        s = parse(text, params, self.limits.hops)
        most = self.limits.rows

        def work() -> list[Row]:
            if most is None:
                return self.read(text, params).collect()
            for arm in s.arms if isinstance(s, Union_) else ():
                self._too_many(plan(self.graph, arm, self.limits).limit(most + 1).count())
            out = self.read(text, params).limit(most + 1).collect()
            self._too_many(len(out))
            return out

        return self.limits.timed(self.graph.spark, work)

    def _too_many(self, n: int) -> None:
        if n > self.limits.rows:
            raise LimitExceeded(f"the result has more than {self.limits.rows} rows")

    def value(self, text: str, params: Mapping[str, object] | None = None) -> object:
        """A single count as a number, a single id column as a list, else the rows."""
        rows = self.rows(text, params)
        columns = rows[0].asDict() if rows else {}
        if len(columns) == 1:
            name = next(iter(columns))
            if name == "count(*)" and len(rows) == 1:
                return rows[0][0]
            if name.endswith(".id"):
                return [r[0] for r in rows]
        return rows

    def page(self, text: str, params: Mapping[str, object] | None = None, cursor: str | None = None, size: int = 100) -> Page:
        """The next `size` rows of a read, and where the page after them begins.

        The first page writes the result once to the shared folder; later ones read their part of it.
        A cursor names the snapshot and the result it belongs to: a page of an older snapshot is still
        served while this engine lives, a cursor of another statement is an error.
        """
        if size < 1:
            raise QueryError("a page has a size from 1")
        s = parse(text, params, self.limits.hops)
        if is_write(s):
            raise QueryError("this statement writes; use write()")
        content = hashlib.sha256(repr(s).encode()).hexdigest()[:16]
        at = 0
        if cursor is not None:
            parts = cursor.split("-")
            if len(parts) != 3 or parts[1] != content or f"{parts[0]}-{content}" not in self._pages:
                raise QueryError("this cursor belongs to no page of the statement")
            name, at = f"{parts[0]}-{content}", int(parts[2])
        else:
            name = f"v{self.graph.version}-{content}"
        if name not in self._pages:
            df = self.read(text, params)
            # ids grow with the partitions, and so with the order of a sorted result
            numbered = written(df.withColumn("#n", F.monotonically_increasing_id()), "pages")
            self._pages[name] = (self.graph.version, numbered, df.columns)
        _, numbered, columns = self._pages[name]
        got = self.limits.timed(self.graph.spark, lambda: numbered.filter(F.col("#n") >= at).orderBy("#n").limit(size + 1).collect())
        place = len(columns)
        rows = [Row(*columns)(*r[:place]) for r in got[:size]]
        return Page(rows, columns, f"{name}-{got[size][place]}" if len(got) > size else None)

    def write(self, text: str, params: Mapping[str, object] | None = None, key: str | None = None) -> Result:
        """Apply a write; with a key, the same write again gives the stored result and another one is a conflict."""
        s = parse(text, params, self.limits.hops)
        if not is_write(s):
            raise QueryError("this statement reads; use read()")
        known = self.ledger.seen(key, s)
        if known is not None:
            return known
        self.graph, result = apply(self.graph, s)
        self.ledger.put(key, s, result)
        return result

    def access(self, text: str, params: Mapping[str, object] | None = None) -> str:
        """`read` or `write`."""
        return "write" if is_write(parse(text, params, self.limits.hops)) else "read"
