"""Path procedures: single pair, single source and multi source.

Simple paths grow hop by hop in a driver loop over DataFrames. With known targets, a reverse
traversal first finds how far each vertex is from one, and only steps that can still arrive are
taken. Where one or only the shortest paths are asked for, a vertex that the source has reached in
fewer hops is not entered again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.cypher.ast import PathCall
from graphloom.cypher.parser import check_name
from graphloom.errors import LimitExceeded, MissingParameter, Unsupported
from graphloom.limits import UNBOUNDED, Limits
from graphloom.sources.graph import PREFIX, Graph
from graphloom.storage import written, written_by

DEFAULT_LIMIT = 100_000
NO_LIMIT = 1 << 31  # a resultLimit from here on cuts nothing
STEP = "struct<edge_type:string,src:bigint,dst:bigint>"
_COMMON = {"relTypes", "relDirection", "maxLen", "weightProp", "costProp", "maxCost", "pathCount", "resultLimit"}
_SINGLE = {"sourceNode", "targetNode"}
_MULTI = {"sourceLabel", "sourceProperty", "sourceValues", "targetLabel", "targetProperty", "targetValues", "pairwise", "fairRelationshipVariants"}


@dataclass(frozen=True)
class Selector:
    label: str
    prop: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class PathSpec:
    kind: str
    rel_types: tuple[str, ...]
    direction: str
    max_len: int
    path_count: int
    result_limit: int
    source: int | None = None
    target: int | None = None
    sources: Selector | None = None
    targets: Selector | None = None
    pairwise: bool = False
    fair: bool = False
    weight: str | None = None
    cost: str | None = None
    max_cost: float | None = None

    @property
    def weighted(self) -> bool:
        return self.weight is not None or self.cost is not None or self.max_cost is not None


def spec(call: PathCall, max_hops: int, default_limit: int = DEFAULT_LIMIT) -> PathSpec:
    c = call.config
    unknown = set(c) - _COMMON - _SINGLE - _MULTI
    if unknown:
        raise Unsupported(f"unknown option {sorted(unknown)[0]}")
    multi = call.kind == "MSpaths"
    wrong = set(c) & (_SINGLE if multi else _MULTI)
    if wrong:
        raise Unsupported(f"algo.{call.kind} does not take {sorted(wrong)[0]}")

    def whole(key: str, default: int | None) -> int | None:
        v = c.get(key)
        if v is None:
            return default
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise Unsupported(f"{key} must be a whole number from 0")
        return v

    def text(key: str) -> str | None:
        v = c.get(key)
        if v is not None and not isinstance(v, str):
            raise Unsupported(f"{key} must be a string")
        return v

    def flag(key: str) -> bool:
        v = c.get(key)
        if v is not None and not isinstance(v, bool):
            raise Unsupported(f"{key} must be true or false")
        return bool(v)

    def strings(key: str) -> tuple[str, ...] | None:
        v = c.get(key)
        if v is None:
            return None
        if not isinstance(v, (list, tuple)) or not all(isinstance(x, str) for x in v):
            raise Unsupported(f"{key} must be a list of strings")
        return tuple(v)

    def selector(prefix: str, default: Selector | None) -> Selector | None:
        values = strings(f"{prefix}Values")
        label, prop = text(f"{prefix}Label"), text(f"{prefix}Property")
        if values is None:
            if label is not None or prop is not None:
                raise Unsupported(f"{prefix}Label and {prefix}Property need {prefix}Values")
            return None
        if not values or "" in values:
            raise Unsupported(f"{prefix}Values holds strings that are not empty")
        label, prop = label or (default and default.label), prop or (default and default.prop)
        if label is None or prop is None:
            raise MissingParameter(f"{prefix}Label and {prefix}Property are missing")
        return Selector(check_name("label", label), check_name("property", prop), values)

    source = target = sources = targets = None
    if multi:
        sources = selector("source", None)
        if sources is None:
            raise MissingParameter("sourceValues is missing")
        targets = selector("target", sources)
        if flag("pairwise") and targets is None:
            raise Unsupported("pairwise needs targetValues")
    else:
        source, target = whole("sourceNode", None), whole("targetNode", None)
        if source is None:
            raise MissingParameter("sourceNode is missing")
        if (call.kind == "SPpaths") != (target is not None):
            raise Unsupported("algo.SPpaths needs targetNode" if call.kind == "SPpaths" else "algo.SSpaths takes no targetNode")
    types = strings("relTypes")
    if not types:
        raise Unsupported("relTypes must be a list of types that is not empty")
    direction = (text("relDirection") or "outgoing").lower()
    if direction not in ("outgoing", "incoming", "both"):
        raise Unsupported("relDirection is outgoing, incoming or both")
    max_len = whole("maxLen", max_hops)
    if max_len > max_hops:
        raise LimitExceeded(f"maxLen {max_len} is over the limit of {max_hops}")
    limit = whole("resultLimit", default_limit)
    if limit == 0:
        raise Unsupported("resultLimit must be over 0")
    most = c.get("maxCost")
    if most is not None and (isinstance(most, bool) or not isinstance(most, (int, float)) or not math.isfinite(most) or most < 0):
        raise Unsupported("maxCost must be a finite number from 0")
    fair = flag("fairRelationshipVariants")
    out = PathSpec(
        call.kind, tuple(dict.fromkeys(check_name("relationship type", t) for t in types)), direction, max_len, whole("pathCount", 1), limit,
        source, target, sources, targets, flag("pairwise"), fair, text("weightProp"), text("costProp"), None if most is None else float(most),
    )
    if fair and not out.pairwise:
        raise Unsupported("fairRelationshipVariants needs pairwise algo.MSpaths")
    if fair and out.weighted:
        raise Unsupported("fairRelationshipVariants takes no weights or costs")
    return out


def selected(g: Graph, s: Selector) -> DataFrame:
    """(id) of the vertices of a label whose string property has one of the values."""
    if not isinstance(g.vertex_type(s.prop), T.StringType):
        return g.vertices.select("id").limit(0)
    return g.vertices.filter(F.array_contains("labels", s.label) & F.col(PREFIX + s.prop).isin(*s.values)).select("id").distinct()


def steps(g: Graph, s: PathSpec) -> DataFrame:
    """(cur, step, next) for every structural edge and direction."""
    e = g.edges(*s.rel_types)
    step = F.struct("edge_type", "src", "dst").alias("step")
    out = e.select(F.col("src").alias("cur"), step, F.col("dst").alias("next"))
    back = e.select(F.col("dst").alias("cur"), step, F.col("src").alias("next"))
    return out if s.direction == "outgoing" else back if s.direction == "incoming" else out.unionAll(back).distinct()


def distance_to(adj: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(v, need): the fewest hops from v to any target, up to hops."""
    seen = targets.select(F.col("id").alias("v"), F.lit(0).alias("need"))
    frontier = seen
    for h in range(1, hops + 1):
        frontier = adj.join(frontier.select(F.col("v").alias("next")), "next").select(F.col("cur").alias("v")).distinct().join(seen, "v", "left_anti").select("v", F.lit(h).alias("need"))
        frontier = written(frontier, "distance")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)  # a union of written tables
    return seen


def least_costs(g: Graph, s: PathSpec) -> DataFrame | None:
    """(step, least): a bound from below on what each structural edge costs; None where costs may be negative or are not numbers."""
    if s.max_cost is None or s.cost is None or not isinstance(g.relationship_type(s.cost), T.NumericType):
        return None
    cost = F.coalesce(F.col(PREFIX + s.cost).cast("double"), F.lit(0.0))
    r = g.relationships.filter(F.col("edge_type").isin(*s.rel_types))
    if not r.filter(cost < 0).isEmpty():
        return None
    return r.groupBy("edge_type", "src", "dst").agg(F.min(cost).alias("least")).select(F.struct("edge_type", "src", "dst").alias("step"), "least")


def enumerate_paths(g: Graph, s: PathSpec, limits: Limits = UNBOUNDED) -> DataFrame:
    """(source, target, nodes, steps) of structural candidate paths.

    Paths that no choice of relationships keeps within maxCost are not carried on.
    """
    spark = g.spark
    bound = least_costs(g, s)
    every = steps(g, s)
    every = every.withColumn("least", F.lit(0.0)) if bound is None else every.join(bound, "step").select(*every.columns, "least")
    adj = written_by(every, "steps", "cur")
    if s.sources is not None:
        sources = selected(g, s.sources)
    else:
        sources = spark.range(1).select(F.lit(s.source).cast("long").alias("id"))
    targets = None
    if s.targets is not None:
        targets = written(selected(g, s.targets), "targets")
    elif s.target is not None:
        targets = written(spark.range(1).select(F.lit(s.target).cast("long").alias("id")), "targets")
    paths = sources.select(F.col("id").alias("source"), F.array("id").alias("nodes"), F.array().cast(f"array<{STEP}>").alias("steps"), F.lit(0.0).alias("spent"))
    need = distance_to(adj.select("cur", "next"), targets, s.max_len) if targets is not None else None
    shortest = not s.weighted and s.path_count in (0, 1)
    reached = sources.select(F.col("id").alias("source"), F.col("id").alias("last"))
    found = None
    pair = Window.partitionBy("source", "target")
    for h in range(1, s.max_len + 1):
        grown = paths.withColumn("cur", F.element_at("nodes", -1)).join(adj, "cur")
        grown = grown.filter(~F.array_contains("nodes", F.col("next"))).withColumn("spent", F.col("spent") + F.col("least"))
        if bound is not None:
            grown = grown.filter(F.col("spent") <= s.max_cost)
        if need is not None:
            grown = grown.join(need.withColumnRenamed("v", "next"), "next").filter(F.col("need") <= s.max_len - h)
        grown = grown.select("source", F.concat("nodes", F.array("next")).alias("nodes"), F.concat("steps", F.array("step")).alias("steps"), "spent", F.col("next").alias("last"))
        if shortest:
            grown = grown.join(reached, ["source", "last"], "left_anti")
            if s.path_count == 1:  # the first path to a vertex begins every first path through it
                grown = grown.withColumn("#r", F.row_number().over(Window.partitionBy("source", "last").orderBy("steps"))).filter("`#r` = 1").drop("#r")
        grown = written(grown, "paths")
        limits.check_rows(grown)
        if grown.isEmpty():
            break
        ended = grown.select("source", F.col("last").alias("target"), "nodes", "steps")
        if targets is not None:
            ended = ended.join(targets.withColumnRenamed("id", "target"), "target", "left_semi")
        if s.pairwise:
            ended = ended.filter("source < target")
        found = ended if found is None else found.unionAll(ended)
        if s.target is not None:  # a single target: paths end there
            grown = grown.filter(F.col("last") != s.target)
            if not s.weighted:
                have = found.count()
                if have and (s.path_count == 0 or have >= s.path_count):
                    break
        if shortest:
            reached = reached.unionAll(grown.select("source", "last"))  # tables written above
        paths = grown.drop("last")
    if found is None:
        return spark.createDataFrame([], f"source long, target long, nodes array<bigint>, steps array<{STEP}>")
    found = found.select("source", "target", "nodes", "steps")
    if s.weighted:
        return found
    if s.path_count == 0:
        return found.withColumn("#m", F.min(F.size("steps")).over(pair)).filter(F.size("steps") == F.col("#m")).drop("#m")
    order = pair.orderBy(F.size("steps"), "steps")
    return found.withColumn("#r", F.row_number().over(order)).filter(F.col("#r") <= s.path_count).drop("#r")


def choices(g: Graph, s: PathSpec, used: DataFrame) -> DataFrame:
    """(step, options): the relationships behind each structural edge, identified ones over the bare one."""
    props = [c for c in g.relationships.columns if c.startswith(PREFIX)]
    key = ["edge_type", "src", "dst"]
    r = g.relationships.filter(F.col("edge_type").isin(*s.rel_types)).join(used, key, "left_semi")
    bare = r.filter("rel_id is null").select(*key, *[F.col(p).alias(f"#{p}") for p in props])
    named = r.filter("rel_id is not null").join(bare, key, "left").select(*key, "rel_id", *[F.coalesce(p, f"#{p}").alias(p) for p in props])
    alone = r.filter("rel_id is null").join(named.select(*key).distinct(), key, "left_anti").select(*key, "rel_id", *props)

    def number(name: str | None, default: float) -> Column:
        t = g.relationship_type(name) if name else None
        return F.coalesce(F.col(PREFIX + name).cast("double"), F.lit(default)) if isinstance(t, T.NumericType) else F.lit(default)

    kv = F.sort_array(F.filter(F.array(*[F.struct(F.lit(p.removeprefix(PREFIX)).alias("k"), F.col(p).cast("string").alias("v")) for p in props]), lambda x: x["v"].isNotNull())) if props else F.array().cast("array<struct<k:string,v:string>>")
    one = F.struct(F.col("rel_id").alias("id"), "edge_type", "src", "dst", kv.alias("props"), number(s.weight, 1.0).alias("weight"), number(s.cost, 0.0).alias("cost"))
    every = named.unionAll(alone).select(F.struct(*key).alias("step"), one.alias("one"))
    return every.groupBy("step").agg(F.sort_array(F.collect_list("one")).alias("options"))


def expand(paths: DataFrame, options: DataFrame, limits: Limits = UNBOUNDED) -> DataFrame:
    """Each structural path once for every choice of relationships along it; how many there will be is checked first."""
    keyed = paths.withColumn("pid", F.xxhash64("source", "nodes", "steps"))
    hops = keyed.select("source", "nodes", "steps", F.posexplode("steps").alias("pos", "step")).join(options, "step")
    lists = hops.groupBy("source", "nodes", "steps").agg(F.sort_array(F.collect_list(F.struct("pos", "options"))).alias("hops"))
    if limits.intermediate is not None:
        choices_of = F.aggregate("hops", F.lit(1.0), lambda a, h: a * F.size(h["options"]))
        limits.check("intermediate", int(lists.agg(F.coalesce(F.sum(choices_of), F.lit(0.0))).first()[0]))
    every = F.expr(
        "aggregate(hops, array(slice(hops[0].options, 1, 0)), (acc, hop) -> flatten(transform(acc, a -> transform(hop.options, o -> concat(a, array(o))))))"
    )
    return lists.select("source", F.element_at("nodes", -1).alias("target"), "nodes", "steps", F.explode(every).alias("rels"))


def run_paths(g: Graph, call: PathCall, limits: Limits, max_rows: int | None = None) -> DataFrame:
    """The columns that the call returns, in the order of sources, targets and selection."""
    s = spec(call, limits.hops, max_rows or DEFAULT_LIMIT)
    paths = written(enumerate_paths(g, s, limits), "candidates")
    used = paths.select(F.explode("steps").alias("s")).select("s.*").distinct()
    full = expand(paths, choices(g, s, used), limits)
    add = lambda name: F.aggregate("rels", F.lit(0.0), lambda a, r: a + r[name])
    full = full.withColumn("weight", add("weight")).withColumn("cost", add("cost"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    full = full.filter(finite(F.col("weight")) & finite(F.col("cost")))
    if s.max_cost is not None:
        full = full.filter(F.col("cost") <= s.max_cost)
    edges = F.transform("rels", lambda r: F.struct(r["edge_type"], r["src"], r["dst"], r["id"]))
    full = full.withColumn("length", F.size("rels")).withColumn("edges", edges)
    order = ["weight", "cost", "length", "nodes", "edges"]
    if s.fair:
        full = _fair(full, paths, s, order)
        rank = ["turn", "structure"]
    else:
        pair = Window.partitionBy("source", "target")
        full = full.withColumn("rank", F.row_number().over(pair.orderBy(*order)))
        if s.path_count == 0:
            full = full.withColumn("#least", F.min("weight").over(pair)).filter("weight = `#least`")
        else:
            full = full.filter(F.col("rank") <= s.path_count)
        rank = ["source", "target", "rank"]
    if s.result_limit < NO_LIMIT:
        full = full.orderBy(*rank).limit(s.result_limit)
    if "path" in call.columns:
        full = hydrate(g, full, rank)
    out = {"path": F.col("path") if "path" in call.columns else None, "pathWeight": F.col("weight"), "pathCost": F.col("cost")}
    return full.orderBy(*rank).select(*[out[c].alias(c) for c in call.columns])


def _fair(full: DataFrame, paths: DataFrame, s: PathSpec, order: list[str]) -> DataFrame:
    """Every structure gets its share of the result limit; structures then take turns."""
    # at most result_limit structures can have a share, so numbering them is bounded work
    first = paths.orderBy("source", "target", F.size("steps"), "steps").limit(s.result_limit)
    numbered = first.select("source", "target", "steps", (F.row_number().over(Window.orderBy("source", "target", F.size("steps"), "steps")) - 1).alias("structure"))
    count = paths.count()
    share, extra = divmod(s.result_limit, max(1, count))
    full = full.join(numbered, ["source", "target", "steps"])
    full = full.withColumn("turn", F.row_number().over(Window.partitionBy("structure").orderBy(*order)))
    return full.filter(F.col("turn") <= F.lit(share) + (F.col("structure") < extra).cast("int"))


def hydrate(g: Graph, full: DataFrame, rank: list[str]) -> DataFrame:
    """path: nodes with labels and properties, and relationships with theirs."""
    props = [c for c in g.vertices.columns if c.startswith(PREFIX)]
    kv = F.sort_array(F.filter(F.array(*[F.struct(F.lit(p.removeprefix(PREFIX)).alias("k"), F.col(p).cast("string").alias("v")) for p in props]), lambda x: x["v"].isNotNull())) if props else F.array().cast("array<struct<k:string,v:string>>")
    none = F.array().cast("array<struct<k:string,v:string>>")
    v = g.vertices.select(F.col("id").alias("node"), "labels", kv.alias("props"))
    keep = list(dict.fromkeys([*rank, "weight", "cost"]))
    rels = F.transform("rels", lambda r: F.struct(r["id"].alias("id"), r["edge_type"].alias("edge_type"), r["src"].alias("src"), r["dst"].alias("dst"), r["props"].alias("props")))
    flat = full.select(*keep, rels.alias("relationships"), F.posexplode("nodes").alias("pos", "node")).join(v, "node", "left")
    one = F.struct("pos", F.col("node").alias("id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", none).alias("props"))
    back = flat.groupBy(*keep, "relationships").agg(F.sort_array(F.collect_list(one)).alias("ns"))
    nodes = F.transform("ns", lambda n: F.struct(n["id"].alias("id"), n["labels"].alias("labels"), n["props"].alias("props")))
    return back.select(*keep, F.struct(nodes.alias("nodes"), "relationships").alias("path"))
