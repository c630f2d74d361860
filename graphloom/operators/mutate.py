"""Writes: each gives a new snapshot and counts; the old snapshot stays as it is."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.cypher.ast import Batch, CreateEdges, Delete, Edge, MergeEdge, Node, RemoveLabels, RemoveProp, SetLabels, SetProp, Update
from graphloom.errors import Conflict, QueryError, Unsupported
from graphloom.operators.points import batch_rows
from graphloom.plans.reader import Reader, col
from graphloom.sources.graph import PREFIX, Graph, type_of
from graphloom.storage import mark_text, read_text, written

EDGE = ["edge_type", "src", "dst"]
#: Snapshots between two that are written to the shared folder to cut their lineage.
CUT_EVERY = 8


@dataclass(frozen=True)
class Result:
    matched: int = 0
    created: int = 0
    updated: int = 0
    deleted: int = 0
    noops: int = 0

    def __add__(self, o: Result) -> Result:
        return Result(self.matched + o.matched, self.created + o.created, self.updated + o.updated, self.deleted + o.deleted, self.noops + o.noops)


@dataclass
class Ledger:
    """Results of keyed writes: the same key with the same content is answered from here.

    With a folder that Spark can write, entries are files there too and outlive this process.
    """

    folder: str | None = None
    spark: SparkSession | None = None
    entries: dict[str, tuple[str, Result]] = field(default_factory=dict)

    def _path(self, key: str) -> str:
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}.json"

    def seen(self, key: str | None, statement: object) -> Result | None:
        if key is None:
            return None
        if key not in self.entries and self.folder is not None and (kept := read_text(self.spark, self._path(key))):
            found = json.loads(kept)
            self.entries[key] = (found["content"], Result(**found["result"]))
        if key not in self.entries:
            return None
        content, result = self.entries[key]
        if content != _content(statement):
            raise Conflict(f"key {key!r} was used for another write")
        return result

    def put(self, key: str | None, statement: object, result: Result) -> None:
        if key is not None:
            self.entries[key] = (_content(statement), result)
            if self.folder is not None:
                mark_text(self.spark, self._path(key), json.dumps({"content": _content(statement), "result": asdict(result)}))


def _content(statement: object) -> str:
    return hashlib.sha256(repr(statement).encode()).hexdigest()


def apply(g: Graph, statement: object) -> tuple[Graph, Result]:
    if isinstance(statement, CreateEdges):
        new, result = _create(g, statement)
    elif isinstance(statement, MergeEdge):
        new, result = _merge(g, statement.edge)
    elif isinstance(statement, Update):
        new, result = _update(g, statement)
    elif isinstance(statement, Batch):
        new, result = _batch(g, statement)
    else:
        raise QueryError("not a write")
    new = Graph(new.vertices, new.relationships, g.version + 1)
    if new.version % CUT_EVERY == 0:
        new = Graph(written(new.vertices, "vertices"), written(new.relationships, "relationships"), new.version)
    return new, result


# schema


def with_property(df: DataFrame, name: str, t: T.DataType) -> DataFrame:
    """df with a column for the property; whole numbers become floats where floats come in."""
    c = PREFIX + name
    if c not in df.columns:
        return df.withColumn(c, F.lit(None).cast(t))
    have = df.schema[c].dataType
    if have == t or isinstance(have, T.DoubleType) and isinstance(t, T.LongType):
        return df
    if isinstance(have, T.NullType):
        return df.withColumn(c, F.col(c).cast(t))
    if isinstance(have, T.IntegralType) and isinstance(t, (T.LongType, T.DoubleType)):
        return df.withColumn(c, F.col(c).cast(t))
    raise QueryError(f"property {name} holds {have.simpleString()}, not {t.simpleString()}")


def _props_frame(g: Graph, ident: dict[str, int | str], props: dict[str, object], labels: tuple[str, ...] | None = None) -> DataFrame:
    cols = [F.lit(v).cast("long" if isinstance(v, int) else "string").alias(k) for k, v in ident.items()]
    if labels is not None:
        cols.append(F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"))
    cols += [F.lit(v).cast(type_of(v)).alias(PREFIX + k) for k, v in props.items()]
    return g.spark.range(1).select(*cols)


def _same(df: DataFrame, like: DataFrame) -> DataFrame:
    def column(c: str) -> Column:
        want = like.schema[c].dataType.simpleString()  # without nullability, which a union adjusts
        if c not in df.columns:
            return F.lit(None).cast(want).alias(c)
        return F.col(c) if df.schema[c].dataType.simpleString() == want else F.col(c).cast(want).alias(c)

    return df.select(*[column(c) for c in like.columns])


def append_relationships(g: Graph, new: DataFrame) -> Graph:
    """new(edge_type, src, dst[, rel_id], p_* ...) behind the relationships."""
    r = g.relationships
    for f in new.schema:
        if f.name.startswith(PREFIX):
            r = with_property(r, f.name.removeprefix(PREFIX), f.dataType)
    return g.replaced(relationships=r.unionAll(_same(new, r)))


def next_id(g: Graph) -> int:
    top = g.relationships.agg(F.max("rel_id")).first()[0]
    return 0 if top is None else top + 1


def _met(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of have, marked `#old`, beside those of new (keys named `#key`) that meet them, and the others of new alone.

    A full outer join that leaves `have` where it lies if new is small: Spark then sends new to it, which it
    cannot do in a full outer join.
    """
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"#{k}") for k in keys])
    names = [f"#{k}" for k in keys]
    there = have.select(*keys).join(new.select(*names), same, "left_semi").distinct().toDF(*names)
    return have.withColumn("#old", F.lit(True)).join(new, same, "left").unionByName(new.join(there, names, "left_anti"), allowMissingColumns=True)


def merge_vertices(g: Graph, new: DataFrame, guard: str | None = None, create_only: tuple[str, ...] = ()) -> tuple[Graph, Result]:
    """Upsert new(id, labels, p_* ...), one row per id: labels are united, properties overwritten.

    With a guard, an existing vertex that has the guard property changes only if the new value is
    larger; create-only properties never change on an existing vertex.
    """
    v = g.vertices
    props = [f for f in new.schema if f.name.startswith(PREFIX)]
    for f in props:
        v = with_property(v, f.name.removeprefix(PREFIX), f.dataType)
    _check_guard_type(v, new, guard)
    n = new.select(F.col("id").alias("#id"), F.col("labels").alias("#labels"), *[F.col(f.name).alias("#" + f.name) for f in props])
    j = _met(v, n, ["id"])
    take = F.col("#id").isNotNull()
    if guard is not None:
        take &= F.coalesce(F.col("#old"), F.lit(False)).__invert__() | F.col(PREFIX + guard).isNull() | (F.col("#" + PREFIX + guard) > F.col(PREFIX + guard))
    names = {f.name for f in props}

    def after(c: str) -> Column:
        if c not in names:
            return F.col(c)
        value = F.coalesce(F.col("#" + c).cast(v.schema[c].dataType), F.col(c))
        if c.removeprefix(PREFIX) in create_only:
            return F.when(F.col("#old").isNull(), value).otherwise(F.col(c))
        return F.when(take, value).otherwise(F.col(c))

    labels = F.when(take, F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("#labels", F.array().cast("array<string>")))).otherwise(F.col("labels"))
    out = j.select(F.coalesce("id", "#id").alias("id"), labels.alias("labels"), *[after(c).alias(c) for c in v.columns if c not in ("id", "labels")])
    changed = reduce(lambda a, b: a | b, [~after(c).eqNullSafe(F.col(c)) for c in names], ~labels.eqNullSafe(F.col("labels")))
    return g.replaced(vertices=out), _counts(j.filter("`#id` is not null"), F.col("#old").isNull(), changed)


def _check_guard_type(have: DataFrame, new: DataFrame, guard: str | None) -> None:
    if guard is None:
        return
    c = PREFIX + guard
    if c not in new.columns:
        raise QueryError(f"the guard {guard} is missing from the rows")
    if have.schema[c].dataType != new.schema[c].dataType:
        raise QueryError(f"the guard {guard} must have the type of the stored property")


def _counts(df: DataFrame, created: Column, changed: Column) -> Result:
    one = lambda c: F.count(F.when(c, 1))
    r = df.agg(F.count("*"), one(created), one(~created & changed), one(~created & ~changed)).first()
    return Result(matched=r[0], created=r[1], updated=r[2], noops=r[3])


# single statements


def _endpoints(g: Graph, *nodes: Node) -> Graph:
    for n in nodes:
        if n.constrained:
            g, _ = merge_vertices(g, _props_frame(g, {"id": n.id}, dict(n.props), n.labels))
    return g


def _create(g: Graph, s: CreateEdges) -> tuple[Graph, Result]:
    if len(s.edges) > 1:
        rows = [(e.type, e.src.id, e.dst.id) for e in s.edges]
        return _structural(g, g.spark.createDataFrame(rows, "edge_type string, src long, dst long"))
    e = s.edges[0]
    new = _props_frame(g, {"edge_type": e.type, "src": e.src.id, "dst": e.dst.id, "rel_id": next_id(g)}, dict(e.props))
    return append_relationships(_endpoints(g, e.src, e.dst), new), Result(created=1)


def _structural(g: Graph, wanted: DataFrame) -> tuple[Graph, Result]:
    """Bare edges for those of wanted(edge_type, src, dst) that no relationship has yet."""
    total = wanted.count()
    new = written(wanted.distinct().join(g.relationships.select(*EDGE).distinct(), EDGE, "left_anti"), "edges")
    n = new.count()
    return (append_relationships(g, new) if n else g), Result(created=n, noops=total - n)


def _merge(g: Graph, e: Edge) -> tuple[Graph, Result]:
    g = _endpoints(g, e.src, e.dst)
    there = g.of_type(e.type).filter((F.col("src") == e.src.id) & (F.col("dst") == e.dst.id))
    bare = not there.filter("rel_id is null").isEmpty()
    props = dict(e.props)
    if there.isEmpty() or props and not bare:
        created = there.isEmpty()
        g = append_relationships(g, _props_frame(g, {"edge_type": e.type, "src": e.src.id, "dst": e.dst.id}, props))
        return g, Result(created=int(created), updated=int(not created))
    if not props:
        return g, Result(noops=1)
    r = g.relationships
    for k, v in props.items():
        r = with_property(r, k, type_of(v))
    hit = (F.col("edge_type") == e.type) & (F.col("src") == e.src.id) & (F.col("dst") == e.dst.id) & F.col("rel_id").isNull()
    new = {PREFIX + k: F.when(hit, F.lit(v).cast(r.schema[PREFIX + k].dataType)).otherwise(F.col(PREFIX + k)) for k, v in props.items()}
    same = r.filter(hit & reduce(lambda a, b: a & b, [F.col(PREFIX + k).eqNullSafe(F.lit(v)) for k, v in props.items()])).isEmpty()
    return g.replaced(relationships=r.withColumns(new)), Result(updated=int(same), noops=int(not same))


def _update(g: Graph, s: Update) -> tuple[Graph, Result]:
    reader = Reader(g, s.groups, set())
    bound = reader.rows()
    rels = [a.var for a in s.actions if a.var in reader.rel_vars]
    for a in s.actions:
        if isinstance(a, (SetLabels, RemoveLabels)) and a.var in reader.rel_vars:
            raise Unsupported("relationships have no labels")
    ids = [f"{v}__id" for v in {a.var for a in s.actions} - set(rels)]
    keys = [f"{r}__{c}" for r in dict.fromkeys(rels) for c in ("type", "src", "dst", "rel")]
    rows = written(bound.df.select(*[col(c).alias(c.replace("#", "_")) for c in dict.fromkeys([*ids, *keys])]), "matched")
    result = Result(matched=rows.count())
    # deletes in order, then sets and removes on what is left, once per entity
    for a in [x for x in s.actions if isinstance(x, Delete)]:
        if a.var in reader.rel_vars:
            g, r = _delete_relationships(g, _targets(rows, a.var))
        else:
            g, r = delete_vertices(g, rows.select(F.col(f"`{a.var}__id`").alias("id")).distinct(), a.detach)
        result += r
    for var in dict.fromkeys(a.var for a in s.actions if not isinstance(a, Delete)):
        mine = [a for a in s.actions if a.var == var and not isinstance(a, Delete)]
        if var in reader.rel_vars:
            g, r = _change_relationships(g, _targets(rows, var), mine)
        else:
            g, r = _change_vertices(g, rows.select(F.col(f"`{var}__id`").alias("id")).distinct(), mine)
        result += r
    return g, result


def _targets(rows: DataFrame, r: str) -> DataFrame:
    return rows.select(*[F.col(f"`{r}__{a}`").alias(b) for a, b in (("type", "edge_type"), ("src", "src"), ("dst", "dst"), ("rel", "rel_id"))]).distinct()


def _applied(df: DataFrame, actions: list[object]) -> tuple[DataFrame, dict[str, Column]]:
    """df with columns for new properties, and what each changed column becomes."""
    after: dict[str, Column] = {}
    for a in actions:
        if isinstance(a, SetProp):
            df = with_property(df, a.name, type_of(a.value))
    for a in actions:
        if isinstance(a, SetProp):
            after[PREFIX + a.name] = F.lit(a.value).cast(df.schema[PREFIX + a.name].dataType)
        elif isinstance(a, RemoveProp):
            if PREFIX + a.name in df.columns:
                after[PREFIX + a.name] = F.lit(None).cast(df.schema[PREFIX + a.name].dataType)
        else:
            labels = after.get("labels", F.coalesce("labels", F.array().cast("array<string>")))
            named = F.array(*map(F.lit, a.labels))
            after["labels"] = F.array_union(labels, named) if isinstance(a, SetLabels) else F.array_except(labels, named)
    return df, after


def _changed(df: DataFrame, hit: Column, after: dict[str, Column]) -> tuple[DataFrame, Result]:
    r = df.filter(hit)
    changed = reduce(lambda a, b: a | b, [~c.eqNullSafe(F.col(k)) for k, c in after.items()], F.lit(False))
    n = r.agg(F.count(F.when(changed, 1)), F.count(F.when(~changed, 1))).first()
    out = df.withColumns({k: F.when(hit, c).otherwise(F.col(k)) for k, c in after.items()})
    return out, Result(updated=n[0], noops=n[1])


def _change_vertices(g: Graph, ids: DataFrame, actions: list[object]) -> tuple[Graph, Result]:
    v, after = _applied(g.vertices, actions)
    if any(isinstance(a, (SetProp, SetLabels)) for a in actions):  # endpoints without a vertex get one
        absent = ids.join(v.select("id"), "id", "left_anti").withColumn("labels", F.array().cast("array<string>"))
        v = v.unionAll(_same(absent, v))
    marked = v.join(ids.withColumn("#hit", F.lit(True)), "id", "left")
    out, result = _changed(marked, F.coalesce("#hit", F.lit(False)), after)
    return g.replaced(vertices=out.select(*v.columns)), result


def _on(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"#{k}")) for k in keys])


def _change_relationships(g: Graph, targets: DataFrame, actions: list[object]) -> tuple[Graph, Result]:
    r, after = _applied(g.relationships, actions)
    keys = [*EDGE, "rel_id"]
    t = targets.select(*[F.col(k).alias(f"#{k}") for k in keys], F.lit(True).alias("#hit"))
    out, result = _changed(r.join(t, _on(keys), "left"), F.coalesce("#hit", F.lit(False)), after)
    return g.replaced(relationships=out.select(*r.columns)), result


def _delete_relationships(g: Graph, targets: DataFrame) -> tuple[Graph, Result]:
    """Records by their id; a bare edge takes all records of its (type, src, dst) with it."""
    keys = [*EDGE, "rel_id"]
    t = targets.select(*[F.col(k).alias(f"#{k}") for k in keys])
    gone = g.relationships.join(t, _on(keys), "left_semi")
    bare = targets.filter("rel_id is null").select(*EDGE)
    deleted = gone.unionAll(g.relationships.join(bare, EDGE, "left_semi").select(*gone.columns)).select(*keys).distinct().count()
    left = g.relationships.join(t, _on(keys), "left_anti").join(bare, EDGE, "left_anti").select(*g.relationships.columns)
    return g.replaced(relationships=left), Result(deleted=deleted)


def delete_vertices(g: Graph, ids: DataFrame, detach: bool) -> tuple[Graph, Result]:
    by_src = F.col("src") == F.col("#id")
    by_dst = F.col("dst") == F.col("#id")
    t = ids.select(F.col("id").alias("#id"))
    incident = g.relationships.join(t, by_src, "left_semi").unionAll(g.relationships.join(t, by_dst, "left_semi"))
    if not detach and not incident.isEmpty():
        raise Conflict("a vertex with relationships needs DETACH DELETE")
    n = ids.count()
    left = g.relationships
    if detach:
        left = left.join(t, by_src, "left_anti").join(t, by_dst, "left_anti")
    return g.replaced(g.vertices.join(ids, "id", "left_anti").select(*g.vertices.columns), left), Result(deleted=n)


# batches


def _batch(g: Graph, b: Batch) -> tuple[Graph, Result]:
    e = b.edge
    ids = {} if e is None or e.src.id is None else {e.src.id.name: "bigint", e.dst.id.name: "bigint"}
    if b.node is not None:
        ids = {b.node.id.name: "bigint"}
    if e is not None and b.form in ("upsert_relationships",):
        ids[dict(e.props)["id"].name] = "bigint"
    named = {f: ids.get(f) or _field_type(b.rows, f) for _, f in b.fields}
    if b.form == "delete_by_props":
        named |= {v.name: _field_type(b.rows, v.name) for _, v in e.props}
    if not b.rows:
        return g, Result()
    rows = batch_rows(g, b.rows, ids | named)
    if e is not None and e.src.id is not None:
        rows = rows.withColumn("edge_type", F.lit(e.type)).withColumn("src", F.col(f"`{e.src.id.name}`")).withColumn("dst", F.col(f"`{e.dst.id.name}`"))
        for n, c in ((e.src, "src"), (e.dst, "dst")):
            if n.labels:  # labelled endpoints must exist
                v = g.vertices
                for label in n.labels:
                    v = v.filter(F.array_contains("labels", label))
                rows = rows.join(v.select(F.col("id").alias(c)), c, "left_semi")
    fields = [F.col(f"`{f}`").alias(PREFIX + k) for k, f in b.fields]
    if b.form in ("create", "create_bound"):
        return _structural(g, rows.select(*EDGE))
    if b.form == "create_relationships":
        rows = written(rows.select("#n", *EDGE, *fields), "batch")
        first = next_id(g)
        # numbered over the rows of one request
        new = rows.withColumn("rel_id", (F.row_number().over(Window.orderBy("#n")) + F.lit(first - 1)).cast("long")).drop("#n")
        return append_relationships(g, new), Result(created=rows.count())
    if b.form == "upsert_relationships":
        rid = dict(e.props)["id"].name
        return upsert_relationships(g, _last(rows.select("#n", *EDGE, F.col(f"`{rid}`").alias("rel_id"), *fields), [*EDGE, "rel_id"], b), b.guard, b.create_only)
    if b.form == "upsert_nodes":
        new = _last(rows.select("#n", F.col(f"`{b.node.id.name}`").alias("id"), F.array(*map(F.lit, b.labels)).cast("array<string>").alias("labels"), *fields), ["id"], b)
        return merge_vertices(g, new, b.guard, b.create_only)
    if b.form == "delete_nodes":
        return delete_vertices(g, written(rows.select(F.col(f"`{b.node.id.name}`").alias("id")).distinct(), "batch"), b.detach)
    if b.form == "delete_edges":
        t = rows.select(*EDGE).distinct()
        deleted = g.relationships.join(t, EDGE, "left_semi").count()
        return g.replaced(relationships=g.relationships.join(t, EDGE, "left_anti").select(*g.relationships.columns)), Result(deleted=deleted)
    if b.form == "delete_by_props":
        if any(g.relationship_type(k) is None for k, _ in e.props):
            return g, Result()
        t = rows.select(F.lit(e.type).alias("edge_type"), *[F.col(f"`{v.name}`").alias(PREFIX + k) for k, v in e.props]).distinct()
        on = ["edge_type", *(PREFIX + k for k, _ in e.props)]
        deleted = g.relationships.join(t, on, "left_semi").count()
        return g.replaced(relationships=g.relationships.join(t, on, "left_anti").select(*g.relationships.columns)), Result(deleted=deleted)
    raise Unsupported(f"batch form {b.form}")


def _field_type(rows: tuple[dict, ...], f: str) -> str:
    kinds = {type_of(r[f]).simpleString() for r in rows if r.get(f) is not None}
    if len(kinds) > 1 and kinds != {"bigint", "double"}:
        raise QueryError(f"field {f} has values of two types")
    return "double" if len(kinds) > 1 else next(iter(kinds), "string")


def _last(rows: DataFrame, key: list[str], b: Batch) -> DataFrame:
    """One row per key, as if the rows came one after another."""
    props = [c for c in rows.columns if c.startswith(PREFIX)]
    if b.guard is not None:
        newest = F.struct(F.col(PREFIX + b.guard), -F.col("#n"))
        pick = lambda c: F.min_by(c, "#n") if c.removeprefix(PREFIX) in b.create_only else F.max_by(c, newest)
    else:
        pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("#n")))
    aggs = [pick(c).alias(c) for c in props]
    if "labels" in rows.columns:
        aggs.insert(0, F.first("labels").alias("labels"))
    return written((rows.groupBy(*key).agg(*aggs) if aggs else rows.select(*key).distinct()), "batch")


def upsert_relationships(g: Graph, new: DataFrame, guard: str | None = None, create_only: tuple[str, ...] = ()) -> tuple[Graph, Result]:
    """Upsert new(edge_type, src, dst, rel_id, p_* ...), one row per relationship; guards as for vertices."""
    r = g.relationships
    props = [f for f in new.schema if f.name.startswith(PREFIX)]
    for f in props:
        r = with_property(r, f.name.removeprefix(PREFIX), f.dataType)
    _check_guard_type(r, new, guard)
    keys = [*EDGE, "rel_id"]
    n = new.select(*[F.col(k).alias(f"#{k}") for k in keys], *[F.col(f.name).alias("#" + f.name) for f in props])
    j = _met(r, n, keys)
    take = F.col("#src").isNotNull()
    if guard is not None:
        take &= F.col("#old").isNull() | F.col(PREFIX + guard).isNull() | (F.col("#" + PREFIX + guard) > F.col(PREFIX + guard))
    after = {}
    for f in props:
        value = F.when(take, F.coalesce(F.col("#" + f.name).cast(r.schema[f.name].dataType), F.col(f.name))).otherwise(F.col(f.name))
        after[f.name] = F.when(F.col("#old").isNull(), value).otherwise(F.col(f.name)) if f.name.removeprefix(PREFIX) in create_only else value
    cols = [F.when(F.col("#old").isNull(), F.col(f"#{c}")).otherwise(F.col(c)).alias(c) if c in keys else after.get(c, F.col(c)).alias(c) for c in r.columns]
    changed = reduce(lambda a, b: a | b, [~c.eqNullSafe(F.col(k)) for k, c in after.items()], F.lit(False))
    return g.replaced(relationships=j.select(*cols)), _counts(j.filter("`#src` is not null"), F.col("#old").isNull(), changed)
