"""What a statement says, with parameters already put in."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

Scalar = Union[bool, int, float, str]


@dataclass(frozen=True)
class RowField:
    """row.name of a batch statement."""

    name: str


@dataclass(frozen=True)
class Node:
    var: str
    labels: tuple[str, ...] = ()
    id: int | RowField | None = None
    props: tuple[tuple[str, object], ...] = ()
    anonymous: bool = False

    @property
    def constrained(self) -> bool:
        return bool(self.labels or self.props)


@dataclass(frozen=True)
class Edge:
    """A relationship pattern from src to dst; hops is the range of a variable length."""

    src: Node
    dst: Node
    type: str
    var: str | None = None
    props: tuple[tuple[str, object], ...] = ()
    hops: tuple[int, int] | None = None


@dataclass(frozen=True)
class Prop:
    """binding.name; name `id` is the vertex id."""

    var: str
    name: str

    @property
    def is_id(self) -> bool:
        return self.name.lower() == "id"


@dataclass(frozen=True)
class Literal:
    value: Scalar


Operand = Union[Prop, Literal]


@dataclass(frozen=True)
class Compare:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class StartsWith:
    left: Operand
    prefix: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Group:
    """One MATCH clause."""

    patterns: tuple[Union[Node, Edge], ...]
    where: object | None = None
    optional: bool = False


@dataclass(frozen=True)
class Aggregate:
    fn: str  # count, sum, avg, collect
    of: Operand | None  # None: count(*)


@dataclass(frozen=True)
class Item:
    of: Union[Prop, Aggregate]
    name: str


@dataclass(frozen=True)
class Sort:
    of: Union[Prop, Aggregate, str]  # str: a column of the result
    ascending: bool


@dataclass(frozen=True)
class Read:
    groups: tuple[Group, ...]
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[Sort, ...] = ()
    skip: int = 0
    limit: int | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(i.name for i in self.items)


@dataclass(frozen=True)
class Union_:
    arms: tuple[Read, ...]
    all: bool


@dataclass(frozen=True)
class CreateEdges:
    edges: tuple[Edge, ...]


@dataclass(frozen=True)
class MergeEdge:
    edge: Edge


@dataclass(frozen=True)
class SetProp:
    var: str
    name: str
    value: Scalar


@dataclass(frozen=True)
class SetLabels:
    var: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class RemoveProp:
    var: str
    name: str


@dataclass(frozen=True)
class RemoveLabels:
    var: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Delete:
    var: str
    detach: bool


@dataclass(frozen=True)
class Update:
    groups: tuple[Group, ...]
    actions: tuple[object, ...]


@dataclass(frozen=True)
class PathCall:
    kind: str  # SPpaths, SSpaths, MSpaths
    config: dict = field(hash=False)
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Batch:
    """UNWIND of a list of maps; form names what is done for each."""

    form: str
    rows: tuple[dict, ...] = field(hash=False)
    edge: Edge | None = None
    node: Node | None = None
    labels: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()  # property, row field
    columns: tuple[str, ...] = ()
    detach: bool = False
    guard: str | None = None
    create_only: tuple[str, ...] = ()


WRITES = (CreateEdges, MergeEdge, Update)


def is_write(statement: object) -> bool:
    """Whether a statement changes the graph."""
    return isinstance(statement, WRITES) or isinstance(statement, Batch) and statement.form != "out_neighbors"
