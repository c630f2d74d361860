"""One statement over several graphs, and results of several statements put together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.errors import QueryError


@dataclass(frozen=True)
class Leg:
    name: str
    graph: str
    text: str
    params: tuple[tuple[str, object], ...] = ()


def run_many(engines: Mapping[str, Engine], text: str, params: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
    """The same read on each graph."""
    return {name: e.read(text, params) for name, e in engines.items()}


def run_legs(engines: Mapping[str, Engine], legs: list[Leg]) -> dict[str, DataFrame]:
    """Lazy results by leg name, in declared order."""
    if len({leg.name for leg in legs}) < len(legs):
        raise QueryError("two legs have the same name")
    missing = [leg.graph for leg in legs if leg.graph not in engines]
    if missing:
        raise QueryError(f"no graph {missing[0]}")
    return {leg.name: engines[leg.graph].read(leg.text, dict(leg.params)) for leg in legs}


def estimate(df: DataFrame) -> int:
    """Bytes that the optimizer expects of the result."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cheapest_first(legs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The legs in the order of their estimates; equal ones as declared."""
    return dict(sorted(legs.items(), key=lambda x: estimate(x[1])))


def union_all(legs: Mapping[str, DataFrame]) -> DataFrame:
    frames = list(legs.values())
    if not frames:
        raise QueryError("no legs")
    if any(f.columns != frames[0].columns for f in frames):
        raise QueryError("legs must have the same columns in the same order")
    return reduce(lambda a, b: a.unionByName(b), frames)


def inner_join(legs: Mapping[str, DataFrame], left: str, left_column: str, right: str, right_column: str) -> DataFrame:
    """Rows of two legs with equal values, NULL matching NULL; columns are named leg.column."""
    sides = []
    for name, column in ((left, left_column), (right, right_column)):
        if name not in legs:
            raise QueryError(f"no leg {name}")
        if column not in legs[name].columns:
            raise QueryError(f"leg {name} has no column {column}")
        df = legs[name]
        sides.append(df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns]))
    return sides[0].join(sides[1], F.col(f"`{left}.{left_column}`").eqNullSafe(F.col(f"`{right}.{right_column}`")))
