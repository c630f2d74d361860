"""The graph: an immutable pair of DataFrames.

vertices(id, labels, p_<name> ...) has at most one row per id; an id may stand in relationships
without one. relationships(edge_type, src, dst, rel_id, p_<name> ...) has one row per relationship;
rel_id NULL marks a bare edge, of which a (type, src, dst) has at most one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import QueryError
from graphloom.storage import mark_text, read_text

VERTEX = T.StructType([T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType()))])
RELATIONSHIP = T.StructType([T.StructField("edge_type", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("src", "dst", "rel_id"))])
PREFIX = "p_"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    relationships: DataFrame
    version: int = 0
    #: Ends of long walks from one vertex, by (type, source, low, high): a snapshot does not change, so they hold while it lives.
    reached: dict[tuple, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    #: The vertices of a loaded snapshot with their folder, `label_set`, which prunes scans of a label.
    by_label: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def vertex_type(self, name: str) -> T.DataType | None:
        return _type(self.vertices, name)

    def relationship_type(self, name: str) -> T.DataType | None:
        return _type(self.relationships, name)

    def of_type(self, edge_type: str) -> DataFrame:
        return self.relationships.filter(F.col("edge_type") == edge_type)

    def edges(self, *types: str) -> DataFrame:
        """Structural edges (edge_type, src, dst), parallel relationships once."""
        r = self.relationships.filter(F.col("edge_type").isin(*types)) if types else self.relationships
        return r.select("edge_type", "src", "dst").distinct()

    def adjacency(self, edge_type: str) -> DataFrame:
        return self.of_type(edge_type).select("src", "dst").distinct()

    def replaced(self, vertices: DataFrame | None = None, relationships: DataFrame | None = None) -> Graph:
        return Graph(vertices if vertices is not None else self.vertices, relationships if relationships is not None else self.relationships, self.version + 1)

    def labelled(self, labels: tuple[str, ...]) -> DataFrame:
        """The vertices that have all of the labels."""
        if not labels or self.by_label is None:
            df = self.vertices
        else:
            df = self.by_label.filter(reduce(lambda a, b: a & b, (F.contains("label_set", F.lit(f"|{x}|")) for x in labels)))
        for x in labels:
            df = df.filter(F.array_contains("labels", x))
        return df

    def save(self, path: str) -> None:
        """Write this snapshot as path/v<version>: vertices by their set of labels and in order of ids, relationships by
        type and in order of sources, so that reads prune other labels and types, and files of other ids."""
        base = f"{path.rstrip('/')}/v{self.version}"
        v = self.vertices.withColumn("label_set", F.concat(F.lit("|"), F.array_join(F.array_sort("labels"), "|"), F.lit("|")))
        v.repartitionByRange("label_set", "id").sortWithinPartitions("label_set", "id").write.partitionBy("label_set").parquet(f"{base}/vertices")
        r = self.relationships.repartitionByRange("edge_type", "src").sortWithinPartitions("edge_type", "src", "dst")
        r.write.partitionBy("edge_type").parquet(f"{base}/relationships")
        schemas = json.dumps([self.vertices.schema.jsonValue(), self.relationships.schema.jsonValue()])
        mark_text(self.spark, f"{base}/schema", schemas)


def _type(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[PREFIX + name].dataType if PREFIX + name in df.columns else None


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], VERTEX), spark.createDataFrame([], RELATIONSHIP))


def load(spark: SparkSession, path: str, version: int) -> Graph:
    """A snapshot that save() wrote; it never changes."""
    base = f"{path.rstrip('/')}/v{version}"
    kept = read_text(spark, f"{base}/schema")
    if kept is None:
        raise QueryError(f"there is no version {version} in {path}")
    v, r = (T.StructType.fromJson(x) for x in json.loads(kept))
    vertices = spark.read.schema(v.add("label_set", T.StringType())).parquet(f"{base}/vertices")
    relationships = spark.read.schema(r).parquet(f"{base}/relationships")
    return Graph(vertices.select(*v.names[:-1]), relationships.select(*r.names), version, by_label=vertices)


def from_rows(spark: SparkSession, vertices: list[dict], relationships: list[dict]) -> Graph:
    """A small graph from Python values: {id, labels, **properties} and {type, src, dst, id, **properties}.

    Relationships without id are bare edges.
    """
    vertex_rows = [({"id": v["id"], "labels": list(v.get("labels", []))}, {k: x for k, x in v.items() if k not in ("id", "labels")}) for v in vertices]
    rel_rows = [
        ({"edge_type": r["type"], "src": r["src"], "dst": r["dst"], "rel_id": r.get("id")}, {k: x for k, x in r.items() if k not in ("type", "src", "dst", "id")})
        for r in relationships
    ]
    return Graph(_frame(spark, vertex_rows, VERTEX), _frame(spark, rel_rows, RELATIONSHIP))


def _frame(spark: SparkSession, rows: list[tuple[dict, dict]], fixed: T.StructType) -> DataFrame:
    kinds: dict[str, T.DataType] = {}
    for _, props in rows:
        for k, x in props.items():
            t = type_of(x)
            if kinds.setdefault(k, t) != t:
                if {kinds[k], t} == {T.LongType(), T.DoubleType()}:
                    kinds[k] = T.DoubleType()
                else:
                    raise QueryError(f"property {k} has values of two types")
    schema = T.StructType([*fixed.fields, *(T.StructField(PREFIX + k, t) for k, t in sorted(kinds.items()))])
    put = lambda x, t: float(x) if isinstance(t, T.DoubleType) and x is not None else x
    return spark.createDataFrame([tuple([*base.values(), *(put(props.get(k), t) for k, t in sorted(kinds.items()))]) for base, props in rows], schema)


def type_of(x: object) -> T.DataType:
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.LongType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, str):
        return T.StringType()
    raise QueryError(f"{x!r} cannot be a property")


def from_frames(vertices: DataFrame, relationships: DataFrame, max_id: bool = False) -> Graph:
    """A graph over DataFrames in the layout above; max_id checks that ids lie in 0 to 2^63 - 1."""
    for df, fixed in ((vertices, VERTEX), (relationships, RELATIONSHIP)):
        missing = set(fixed.names) - set(df.columns)
        if missing:
            raise QueryError(f"missing columns: {', '.join(sorted(missing))}")
    if max_id:
        check = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is out of range"))).otherwise(F.col(c))
        vertices = vertices.withColumn("id", check("id"))
        relationships = relationships.withColumn("src", check("src")).withColumn("dst", check("dst"))
    return Graph(vertices, relationships)


#: Where the ids of each label of the table view begin.
OFFSETS = {"Region": 10**12, "Nation": 2 * 10**12, "Customer": 3 * 10**12, "Supplier": 4 * 10**12, "Part": 5 * 10**12, "Order": 6 * 10**12, "User": 7 * 10**12}


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph view of the order tables: labels and types are constants of each part of a union, so a
    pattern's filters drop the parts that it does not ask for before anything is read."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ident = lambda label, c: (F.col(c).cast("long") + F.lit(OFFSETS[label]))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")

    def vertices(label: str, df: DataFrame, key: str, **props: Column | str) -> DataFrame:
        cols = [F.col(v).alias(PREFIX + k) if isinstance(v, str) else v.alias(PREFIX + k) for k, v in props.items()]
        return df.select(ident(label, key).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(key).cast("long").alias("p_key"), *cols)

    v = [
        vertices("Region", t("region"), "r_regionkey", name="r_name"),
        vertices("Nation", t("nation"), "n_nationkey", name="n_name"),
        vertices("Customer", t("customer"), "c_custkey", name="c_name", segment="c_mktsegment", acctbal="c_acctbal", acctbal_cents=cents("c_acctbal")),
        vertices("Supplier", t("supplier"), "s_suppkey", name="s_name", acctbal="s_acctbal"),
        vertices("Part", t("part"), "p_partkey", name="p_name", brand="p_brand", type="p_type", size=F.col("p_size").cast("long"), price_cents=cents("p_retailprice")),
        vertices("Order", t("orders"), "o_orderkey", status="o_orderstatus", total_cents=cents("o_totalprice"), priority="o_orderpriority", odate=F.unix_timestamp("o_orderdate")),
        vertices("User", t("events").select("user_id").distinct(), "user_id"),
    ]

    def relationships(kind: str, df: DataFrame, src: Column, dst: Column, rel_id: Column, **props: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), rel_id.cast("long").alias("rel_id"), *[c.alias(PREFIX + k) for k, c in props.items()])

    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    supplier, part, pair = ident("Supplier", "l_suppkey"), ident("Part", "l_partkey"), F.xxhash64("l_suppkey", "l_partkey")
    content = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    r = [
        relationships("IN_REGION", t("nation"), ident("Nation", "n_nationkey"), ident("Region", "n_regionkey"), F.col("n_nationkey")),
        relationships("LIVES_IN", t("customer"), ident("Customer", "c_custkey"), ident("Nation", "c_nationkey"), F.col("c_custkey")),
        relationships("BASED_IN", t("supplier"), ident("Supplier", "s_suppkey"), ident("Nation", "s_nationkey"), F.col("s_suppkey")),
        relationships("PLACED", t("orders"), ident("Customer", "o_custkey"), ident("Order", "o_orderkey"), F.col("o_orderkey")),
        relationships(
            "CONTAINS", t("lineitem"), ident("Order", "l_orderkey"), part, content, qty=F.col("l_quantity").cast("long"), ext_cents=cents("l_extendedprice"), flag=F.col("l_returnflag"), line=F.col("l_linenumber").cast("long")
        ),
        relationships("SUPPLIES", supplies, supplier, part, pair),
        relationships("TRADES", supplies, supplier, part, pair),
        relationships("TRADES", supplies, part, supplier, pair),
    ]
    return Graph(_union(v), _union(r))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def from_jsonl(spark: SparkSession, path: str) -> Graph:
    """A dump of manifest.json, nodes.jsonl (id, labels, properties) and edges.jsonl (id, type, source_id, target_id, properties).

    Null, list and map properties become their JSON text, whole floats become integers where a
    property has no other floats, and _fid equal to the id is added to nodes and edges. A count in the manifest
    that the files do not match is an error.
    """
    base = path.rstrip("/")
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{base}/manifest.json").limit(10_000).collect()))
    if not ("graph" in manifest or {"org_id", "tenant_id"} <= set(manifest)):
        raise QueryError("the manifest names neither a graph nor an org_id and tenant_id")
    raw = T.MapType(T.StringType(), T.StringType())
    nodes = spark.read.schema(T.StructType([*VERTEX.fields, T.StructField("properties", T.StringType())])).json(f"{base}/nodes.jsonl")
    edges = spark.read.schema("id long, type string, source_id long, target_id long, properties string").json(f"{base}/edges.jsonl")
    for df, key in ((nodes, "node_count"), (edges, "edge_count")):
        if key in manifest and df.count() != manifest[key]:
            raise QueryError(f"{key} of the manifest is {manifest[key]}, the file has {df.count()}")
    nodes = nodes.withColumn("m", F.from_json("properties", raw))
    edges = edges.withColumn("m", F.from_json("properties", raw))
    vertices = nodes.select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), *_typed(nodes), F.col("id").alias("p__fid"))
    rels = edges.select(F.col("type").alias("edge_type"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("id").alias("rel_id"), *_typed(edges), F.col("id").alias("p__fid"))
    return Graph(vertices, rels)


def _typed(df: DataFrame) -> list[Column]:
    """A column for each property: its type is what all of its values in the dump have in common."""
    quoted = F.from_json("properties", T.MapType(T.StringType(), T.VariantType()))
    kinds = df.select(F.explode(quoted).alias("k", "v")).select("k", F.schema_of_variant("v").alias("t")).groupBy("k").agg(F.collect_set("t").alias("ts"))
    out = []
    for row in kinds.orderBy("k").collect():  # one row per property name
        ts, text = set(row["ts"]), F.col("m")[row["k"]]
        if ts == {"BOOLEAN"}:
            column = text.cast("boolean")
        elif ts == {"BIGINT"}:
            column = text.cast("long")
        elif all(t == "BIGINT" or t == "DOUBLE" or t.startswith("DECIMAL") for t in ts):
            column = text.cast("double")
        else:
            column = F.coalesce(text, F.when(F.map_contains_key("m", row["k"]), F.lit("null")))
        if row["k"] != "_fid":
            out.append(column.alias(PREFIX + row["k"]))
    return out
