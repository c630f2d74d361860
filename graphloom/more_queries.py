"""More queries with SQL twins: edges, batches, sources, snapshots, limits, and what is refused.

Importing this module adds them to those of graphloom.queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.errors import QueryError
from graphloom.functions import stats
from graphloom.functions.text import explain, fingerprint, run_features, shape
from graphloom.functions.verify import digest, verify
from graphloom.limits import Limits
from graphloom.operators import bulk, points
from graphloom.operators.legs import Leg, cheapest_first, run_legs, run_many, union_all
from graphloom.operators.mutate import Ledger
from graphloom.operators.statements import CreateEdge, MatchEdge, MatchOut, MatchOutFiltered, MatchReachable
from graphloom.queries import ORACLE_SQL, QUERIES, after, paths, query, text, view
from graphloom.queries import C, N, O, P, R, S, U
from graphloom.sources.graph import from_jsonl, load
from graphloom.sources.sinks import iterate, json_body
from graphloom.storage import mark_text, scratch_dir

__all__ = ["ORACLE_SQL", "QUERIES"]


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# reads

text(
    "bound_relationship_property", "MATCH (o:Order)-[:CONTAINS]->(p:Part) MATCH (o)-[r:CONTAINS]->(p) WHERE r.qty = 50 RETURN o.key AS o, p.key AS p, r.line AS line",
    "SELECT a.l_orderkey AS o, a.l_partkey AS p, CAST(b.l_linenumber AS BIGINT) AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE CAST(b.l_quantity AS BIGINT) = 50",
)
text(
    "relationship_variable_again", "MATCH (o:Order)-[r:CONTAINS]->(p) WITH o, r, p MATCH (o)-[r:CONTAINS]->(q) RETURN o.key AS o, p.id AS p, q.id AS q, r.line AS line",
    f"SELECT l_orderkey AS o, {P} + l_partkey AS p, {P} + l_partkey AS q, CAST(l_linenumber AS BIGINT) AS line FROM lineitem",
)
text(
    "distinct_then_order", "MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.size AS s ORDER BY s DESC, b SKIP 3 LIMIT 20",
    "SELECT DISTINCT p_brand AS b, CAST(p_size AS BIGINT) AS s FROM part ORDER BY s DESC, b LIMIT 20 OFFSET 3",
)
text("limit_zero_arm", "MATCH (r:Region) RETURN r.key AS k LIMIT 0 UNION ALL MATCH (r:Region) RETURN r.key AS k ORDER BY k LIMIT 2", "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region ORDER BY k LIMIT 2")
text("window_of_a_count", "MATCH (n:Nation) RETURN count(*) AS n SKIP 1 UNION ALL MATCH (n:Nation) RETURN count(*) AS n SKIP 0 LIMIT 1", "SELECT count(*) AS n FROM nation")
text("parameters", "MATCH (c:Customer) WHERE c.segment = $s AND c.acctbal_cents >= $least RETURN c.key AS k, c.acctbal AS a", "SELECT c_custkey AS k, c_acctbal AS a FROM customer WHERE c_mktsegment = 'BUILDING' AND round(c_acctbal * 100) >= 100000", s="BUILDING", least=100_000)
text("column_names", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.key, r.name AS `the region`, count(*)", 'SELECT CAST(n_nationkey AS BIGINT) AS "n.key", r_name AS "the region", 1::BIGINT AS "count(*)" FROM nation JOIN region ON r_regionkey = n_regionkey')
text(
    "optional_reach", f"MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES*1..2]->(p:Part {{size: 7}}) RETURN s.key AS s, p.key AS p",
    "SELECT s_suppkey AS s, p AS p FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS k, p_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = 7) ON k = s_suppkey",
)
text(
    "long_reach", f"MATCH (s {{id: {S}}})-[:TRADES*2..5]->(v) RETURN v.id AS v",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey + {S} AS a, l_partkey + {P} AS b FROM lineitem UNION ALL SELECT DISTINCT l_partkey + {P}, l_suppkey + {S} FROM lineitem),
w(v, h) AS (SELECT {S}::BIGINT, 0 UNION SELECT e.b, h + 1 FROM w JOIN e ON e.a = w.v WHERE h < 5) SELECT DISTINCT v FROM w WHERE h BETWEEN 2 AND 5""",
)


@query("edges_of_type", f"SELECT 'BASED_IN' AS edge_type, {S} + s_suppkey AS src, {N} + s_nationkey AS dst FROM supplier")
def edges_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).edges("BASED_IN")


@query("point_reads", f"SELECT 'out' AS kind, {P} + l_partkey AS id FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1) UNION ALL SELECT 'in', {C} + c_custkey FROM customer WHERE c_nationkey = 15 UNION ALL SELECT 'degree', count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = 1")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir)
    parts = [("out", points.out_neighbors(g, "SUPPLIES", S + 1)), ("in", points.in_neighbors(g, "LIVES_IN", N + 15)), ("degree", points.out_degree(g, "SUPPLIES", S + 1).toDF("id"))]
    return reduce(lambda a, b: a.unionAll(b), (df.select(F.lit(k).alias("kind"), "id") for k, df in parts))


@query(
    "built_statements",
    f"""SELECT 'out' AS form, {P} + l_partkey AS id FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 2) UNION ALL SELECT 'count', count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = 2
UNION ALL SELECT 'filtered', {P} + p_partkey FROM (SELECT DISTINCT p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = 2 AND p_size > 20)
UNION ALL SELECT 'edge', CAST(count(*) > 0 AS BIGINT) FROM lineitem WHERE l_suppkey = 2 AND l_partkey = 3 UNION ALL SELECT 'reach', count(DISTINCT b.l_suppkey) FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey = 2
UNION ALL SELECT 'created', 1""",
)
def built_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(view(spark, sf_dir))
    before = [MatchOut("SUPPLIES", S + 2).run(e), MatchOut("SUPPLIES", S + 2, return_count=True).run(e), MatchOutFiltered("SUPPLIES", S + 2, ("Part",), (("size", ">", 20),)).run(e)]
    reach = MatchReachable("TRADES", S + 2, 2, 2, return_count=True).run(e)
    edge = MatchEdge("SUPPLIES", S + 2, P + 3).run(e)
    CreateEdge("MARKED", S + 2, P, props=(("w", 1),)).run(e)
    flags = spark.createDataFrame([("edge", int(edge)), ("created", int(MatchEdge("MARKED", S + 2, P).run(e)))], "form string, id long")
    named = [df.toDF("id").select(F.lit(k).alias("form"), F.col("id").cast("long").alias("id")) for k, df in zip(("out", "count", "filtered", "reach"), [*before, reach])]
    return reduce(lambda a, b: a.unionAll(b), [*named, flags])


@query("many_graphs", "SELECT 'before' AS g, count(*) AS n FROM supplier UNION ALL SELECT 'after', 2 * count(*) FROM supplier WHERE s_nationkey <> 15")
def many_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same read on two graphs, and legs over both: what is gone from one is gone from its leg alone."""
    a, b = Engine(view(spark, sf_dir)), Engine(view(spark, sf_dir))
    b.write("MATCH (s:Supplier)-[:BASED_IN]->(n {id: %d}) DETACH DELETE s" % (N + 15))
    q = "MATCH (s:Supplier) RETURN s.id AS id"
    n = {k: df.count() for k, df in run_many({"a": a, "b": b}, q).items()}
    legs = cheapest_first(run_legs({"a": a, "b": b}, [Leg("x", "b", q), Leg("y", "b", q)]))
    return spark.createDataFrame([("before", n["a"])], "g string, n long").unionAll(union_all(legs).agg(F.count("*").alias("n")).select(F.lit("after"), "n"))


@query("paged", "SELECT n_name AS name, CAST((row_number() OVER (ORDER BY n_name) - 1) // 7 AS BIGINT) AS page FROM nation")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out, cursor, n = Engine(view(spark, sf_dir)), [], None, 0
    while True:
        page = e.page("MATCH (n:Nation) RETURN n.name AS name ORDER BY name", cursor=cursor, size=7)
        out += [(r.name, n) for r in page.rows]
        if page.next_cursor is None:
            return spark.createDataFrame(out, "name string, page long")
        cursor, n = page.next_cursor, n + 1


@query("paged_paths", f"SELECT [{R + 1}::BIGINT, {N} + n_nationkey] AS nodes, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 2 AS BIGINT) AS page FROM nation WHERE n_regionkey = 1")
def paged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out, cursor, n = Engine(view(spark, sf_dir)), [], None, 0
    call = f"CALL algo.SSpaths({{sourceNode: {R + 1}, relTypes: ['IN_REGION'], relDirection: 'incoming', maxLen: 1}}) YIELD path RETURN path"
    while True:
        page = e.page(call, cursor=cursor, size=2)
        out += [([x.id for x in r.path.nodes], n) for r in page.rows]
        if page.next_cursor is None:
            return spark.createDataFrame(out, "nodes array<bigint>, page long")
        cursor, n = page.next_cursor, n + 1


@query("unwrapped_values", f"SELECT 'count' AS kind, count(*) AS v FROM nation UNION ALL SELECT 'id', {R} + r_regionkey FROM region UNION ALL SELECT 'rows', CAST(n_nationkey AS BIGINT) FROM nation")
def unwrapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(view(spark, sf_dir))
    rows = [("count", e.value("MATCH (n:Nation) RETURN count(*)"))] + [("id", i) for i in e.value("MATCH (r:Region) RETURN r.id")]
    return spark.createDataFrame(rows + [("rows", r.k) for r in e.value("MATCH (n:Nation) RETURN n.key AS k")], "kind string, v long")


@query("sinks", "SELECT 'json' AS sink, r_name AS name FROM region UNION ALL SELECT 'rows', r_name FROM region")
def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(view(spark, sf_dir)).read("MATCH (r:Region) RETURN r.name AS name")
    body = spark.createDataFrame([(json_body(df, 100),)], "b string").select(F.explode(F.from_json("b", "columns array<string>, rows array<array<string>>")["rows"]).alias("r"))
    return body.select(F.lit("json").alias("sink"), F.col("r")[0].alias("name")).unionAll(spark.createDataFrame([("rows", r["name"]) for r in iterate(df)], "sink string, name string"))


# paths

paths(
    "k_shortest_paths", "SPpaths", f"sourceNode: {S}, targetNode: {S + 1}, relTypes: ['TRADES'], maxLen: 2, pathCount: 5",
    f"SELECT [{S}::BIGINT, {P} + p, {S + 1}] AS nodes, 2.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM (SELECT DISTINCT a.l_partkey AS p FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = 0 AND b.l_suppkey = 1) ORDER BY p LIMIT 5",
)
paths(
    "result_limit_in_order", "SSpaths", f"sourceNode: {R + 1}, relTypes: ['IN_REGION', 'LIVES_IN'], relDirection: 'incoming', maxLen: 2, resultLimit: 11",
    f"SELECT nodes, CAST(len(nodes) - 1 AS DOUBLE) AS pathWeight, 0.0::DOUBLE AS pathCost FROM (SELECT [{R + 1}::BIGINT, {N} + n_nationkey] AS nodes FROM nation WHERE n_regionkey = 1 UNION ALL SELECT [{R + 1}::BIGINT, {N} + n_nationkey, {C} + c_custkey] FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1) ORDER BY nodes[-1] LIMIT 11",
)
paths(
    "grouped_targets", "MSpaths", "sourceLabel: 'Region', sourceProperty: 'name', sourceValues: ['AFRICA', 'AMERICA'], targetLabel: 'Nation', targetProperty: 'name', targetValues: ['NATION_0', 'NATION_1', 'NATION_5', 'NATION_7'], relTypes: ['IN_REGION'], relDirection: 'incoming', maxLen: 2",
    f"SELECT [{R} + r_regionkey, {N} + n_nationkey] AS nodes, 1.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('AFRICA', 'AMERICA') AND n_name IN ('NATION_0', 'NATION_1', 'NATION_5', 'NATION_7')",
)
paths(
    "paths_within_cost", "SSpaths", f"sourceNode: {O + 1}, relTypes: ['CONTAINS'], maxLen: 1, weightProp: 'qty', costProp: 'line', maxCost: 4, pathCount: 9",
    f"SELECT [{O + 1}::BIGINT, {P} + l_partkey] AS nodes, CAST(l_quantity AS DOUBLE) AS pathWeight, CAST(l_linenumber AS DOUBLE) AS pathCost FROM lineitem WHERE l_orderkey = 1 AND l_linenumber <= 4",
)

TWICE = "(SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1 ORDER BY l_orderkey LIMIT 1)"


@query("parallel_choices", f"SELECT [{O} + l_orderkey, {P} + l_partkey] AS nodes, CAST(l_quantity AS DOUBLE) AS pathWeight, CAST(l_linenumber AS DOUBLE) AS pathCost FROM lineitem WHERE l_orderkey = {TWICE}")
def parallel_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relationship of a pair that has several is a path of its own."""
    g = view(spark, sf_dir)
    pair = g.of_type("CONTAINS").groupBy("src", "dst").count().filter("count > 1").orderBy("src").first()
    call = f"CALL algo.SSpaths({{sourceNode: {pair['src']}, relTypes: ['CONTAINS'], maxLen: 1, weightProp: 'qty', costProp: 'line', pathCount: 99}}) YIELD path, pathWeight, pathCost RETURN path, pathWeight, pathCost"
    return Engine(g).read(call).select(F.transform("path.nodes", lambda n: n["id"]).alias("nodes"), "pathWeight", "pathCost")


# writes: the result is a read of the new snapshot, or what the write says it did

after("self_loop", "UNWIND $rows AS row CREATE (a {id: row.a})-[:TRADES]->(b {id: row.b})", "MATCH (a:Supplier)-[:TRADES]->(a) RETURN a.key AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey IN (1, 4)", rows=[{"a": S + 1, "b": S + 1}, {"a": S + 4, "b": S + 4}, {"a": S + 1, "b": S + 2}])
after("set_from_values", "MATCH (p:Part)<-[r:SUPPLIES]-(s {id: %d}) SET p.picked = true, r.rank = 7" % S, "MATCH (s)-[r:SUPPLIES {rank: 7}]->(p:Part {picked: true}) RETURN s.key AS s, p.key AS p", "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey = 0")
after("delete_unconnected", "MATCH (u:User) DELETE u", "MATCH (u:User) RETURN count(*) AS n UNION ALL MATCH (r:Region) RETURN count(*) AS n", "SELECT 0::BIGINT AS n UNION ALL SELECT count(*) FROM region")
after("batch_create_labelled", "UNWIND $rows AS row MATCH (s:Supplier {id: row.a}), (d:Part {id: row.b}) CREATE (s)-[:BACKS]->(d)", "MATCH (s)-[:BACKS]->(p) RETURN s.key AS s, p.key AS p", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (3, 4)) t(s, p)", rows=[{"a": S + 1, "b": P + 2}, {"a": S + 3, "b": P + 4}, {"a": C + 3, "b": P + 4}, {"a": S + 1, "b": R}])
after("batch_create_relationships", "UNWIND $rows AS row MATCH (s {id: row.a}), (d {id: row.b}) CREATE (s)-[:BACKS {id: row.i, k: row.k}]->(d)", "MATCH (s)-[r:BACKS]->(p) RETURN s.key AS s, p.key AS p, r.k AS k", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 'x'), (1, 2, 'y')) t(s, p, k)", rows=[{"a": S + 1, "b": P + 2, "i": 1, "k": "x"}, {"a": S + 1, "b": P + 2, "i": 2, "k": "y"}])
after("batch_merge_relationships", "UNWIND $rows AS row MATCH (s {id: row.a}), (d {id: row.b}) MERGE (s)-[r:LIVES_IN {id: row.i}]->(d) SET r.since = row.y", "MATCH (c)-[r:LIVES_IN]->(n) WHERE r.since > 0 RETURN c.key AS c, n.key AS n, r.since AS y", "SELECT * FROM (VALUES (3::BIGINT, 4::BIGINT, 1990::BIGINT), (3, 5, 2000)) t(c, n, y)", rows=[{"a": C + 3, "b": N + 4, "i": 10**9, "y": 1990}, {"a": C + 3, "b": N + 5, "i": 10**9, "y": 2000}])
after("batch_delete_by_property", "UNWIND $rows AS row MATCH ()-[r:CONTAINS {flag: row.f}]->() DELETE r", "MATCH (o)-[r:CONTAINS]->(p) RETURN r.flag AS flag, count(*) AS n", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1", rows=[{"f": "R"}, {"f": "none"}])
after("batch_detach_delete", "UNWIND $rows AS row MATCH (n {id: row.i}) DETACH DELETE n", "MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN n.id AS n, count(*) AS k", f"SELECT {N} + c_nationkey AS n, count(*) AS k FROM customer WHERE c_nationkey NOT IN (1, 15) GROUP BY 1", rows=[{"i": N + 1}, {"i": N + 15}, {"i": 5}])
after("batch_delete_between", "UNWIND $rows AS row MATCH (a {id: row.a})-[r:IN_REGION]->(b {id: row.b}) DELETE r", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.key AS n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE NOT (n_nationkey = 0 AND n_regionkey = 0)", rows=[{"a": N, "b": R}, {"a": N + 1, "b": R}])


@query(
    "write_counts",
    """SELECT 'set' AS w, count(*) AS matched, 0::BIGINT AS created, count(*) AS updated, 0::BIGINT AS deleted, 0::BIGINT AS noops FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'set again', count(*), 0, 0, 0, count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'create', 0, 1, 0, 0, 0 UNION ALL SELECT 'merge', 0, 0, 0, 0, 1
UNION ALL SELECT 'delete', count(*), 0, 0, count(*), 0 FROM orders WHERE o_orderstatus = 'P'""",
)
def write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(view(spark, sf_dir))
    writes = {
        "set": "MATCH (c:Customer) WHERE c.segment = 'BUILDING' SET c.tier = 2", "set again": "MATCH (c:Customer) WHERE c.segment = 'BUILDING' SET c.tier = 2", "create": f"CREATE (a {{id: {R}}})-[:NEAR]->(b {{id: {R + 1}}})",
        "merge": f"MERGE (a {{id: {R}}})-[:NEAR]->(b {{id: {R + 1}}})", "delete": "MATCH (c)-[r:PLACED]->(o:Order) WHERE o.status = 'P' DELETE r",
    }
    rows = [(k, *(getattr(r, c) for c in ("matched", "created", "updated", "deleted", "noops"))) for k, w in writes.items() for r in (e.write(w),)]
    return spark.createDataFrame(rows, "w string, matched long, created long, updated long, deleted long, noops long")


@query("idempotency_key", "SELECT 'first' AS w, 1::BIGINT AS created, 1::BIGINT AS version UNION ALL SELECT 'again', 1, 1 UNION ALL SELECT 'elsewhere', 1, 0")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed write is done once, also for an engine that only shares the ledger's folder."""
    folder = place(spark, "ledger")
    e, other = (Engine(view(spark, sf_dir), ledger=Ledger(folder, spark)) for _ in range(2))
    w = f"CREATE (a {{id: {R}}})-[:NEAR]->(b {{id: {R + 1}}})"
    return spark.createDataFrame([(k, x.write(w, key="k").created, x.graph.version) for k, x in (("first", e), ("again", e), ("elsewhere", other))], "w string, created long, version long")


@query("bulk_edges", f"SELECT {S} + s_suppkey AS src, {R} + n_regionkey AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey <> 15")
def bulk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir)
    e = Engine(g).read("MATCH (s:Supplier)-[:BASED_IN]->(n)-[:IN_REGION]->(r) RETURN s.id AS src, r.id AS dst, n.key AS n")
    g, _ = bulk.import_edges(g, e.select(F.lit("WITHIN").alias("edge_type"), "src", "dst"))
    g, _ = bulk.delete_edges(g, e.filter("n = 15").select(F.lit("WITHIN").alias("edge_type"), "src", "dst"))
    return g.edges("WITHIN").select("src", "dst")


@query("bulk_vertices", "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS rank FROM region")
def bulk_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir)
    new = g.vertices.filter(F.array_contains("labels", "Region")).select("id", F.array(F.lit("Ranked")).alias("labels"), F.col("p_key").alias("p_rank"))
    g, _ = bulk.import_vertices(g, new)
    return Engine(g).read("MATCH (r:Ranked) RETURN r.name AS name, r.rank AS rank")


@query("ingested_changes", f"SELECT {C} + o_custkey AS src, {O} + o_orderkey AS dst FROM orders WHERE o_orderstatus <> 'F' UNION SELECT 1, 2")
def ingested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of an edge holds."""
    g = view(spark, sf_dir)
    gone = Engine(g).read("MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN c.id AS src, o.id AS dst")
    change = lambda df, op, seq: df.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), F.lit("PLACED").alias("edge_type"), "src", "dst")
    one = spark.createDataFrame([(1, 2)], "src long, dst long")
    return bulk.ingest(g, change(gone, "put", 1).unionAll(change(gone, "delete", 2)).unionAll(change(one, "delete", 1)).unionAll(change(one, "put", 2))).edges("PLACED").select("src", "dst")


# sources and snapshots


@query("jsonl_dump", "SELECT n_name AS n, r_name AS r, CAST(n_nationkey AS BIGINT) AS w, 2.5::DOUBLE + n_nationkey AS f FROM nation JOIN region ON r_regionkey = n_regionkey")
def jsonl_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump written to the shared folder and read back as a graph."""
    base = place(spark, "dump")
    v = view(spark, sf_dir).vertices.filter("labels[0] in ('Region', 'Nation')")
    nodes = v.select("id", "labels", F.struct(F.col("p_name").alias("name")).alias("properties"))
    edges = view(spark, sf_dir).of_type("IN_REGION").select(F.col("rel_id").alias("id"), F.col("edge_type").alias("type"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.struct(F.col("rel_id").alias("w"), (F.col("rel_id") + F.lit(2.5)).alias("f")).alias("properties"))
    nodes.write.json(f"{base}/nodes.jsonl")
    edges.write.json(f"{base}/edges.jsonl")
    mark_text(spark, f"{base}/manifest.json", f'{{"graph": "g", "node_count": {nodes.count()}, "edge_count": {edges.count()}}}')
    return Engine(from_jsonl(spark, base)).read("MATCH (n:Nation)-[r:IN_REGION]->(m:Region) RETURN n.name AS n, m.name AS r, r.w AS w, r.f AS f")


@query("snapshot_versions", "SELECT 0::BIGINT AS version, r_name AS name, NULL::BIGINT AS rank FROM region UNION ALL SELECT 1, r_name, 1 FROM region")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions in one folder, each read as it was saved; the handle of the older one does not change."""
    base = place(spark, "snapshots")
    e = Engine(view(spark, sf_dir))
    old = e.graph
    old.save(base)
    e.write("MATCH (r:Region) SET r.rank = 1")
    e.graph.save(base)
    q = "MATCH (r:Region) RETURN r.name AS name, r.rank AS rank"
    parts = [Engine(load(spark, base, n)).read(q).select(F.lit(n).cast("long").alias("version"), "name", F.col("rank").cast("long").alias("rank")) for n in (0, 1)]
    assert Engine(old).read(q).filter("rank is not null").isEmpty()
    return parts[0].unionAll(parts[1])


# statistics and checks


@query("edge_histogram", "SELECT CAST(l_linenumber AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_histogram(view(spark, sf_dir), "CONTAINS", "line")


@query("histogram_summary", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values, max(n) AS most_common FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(stats.vertex_histogram(view(spark, sf_dir), "brand"))


@query("refreshed_statistics", "SELECT 'label' AS kind, 'Part' AS name, count(*) AS n FROM part UNION ALL SELECT 'edge_type', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'vertex_property', 'segment', count(*) FROM customer UNION ALL SELECT 'relationship_property', 'qty', count(*) FROM lineitem")
def refreshed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = place(spark, "stats")
    stats.refresh(view(spark, sf_dir), folder)
    return stats.refresh(view(spark, sf_dir), folder).filter("name in ('Part', 'CONTAINS', 'segment', 'qty')")


EVERY_EDGE = f"""e AS (SELECT 1 AS t, {N} + n_nationkey AS a, {R} + n_regionkey AS b FROM nation UNION SELECT 2, {C} + c_custkey, {N} + c_nationkey FROM customer UNION SELECT 3, {S} + s_suppkey, {N} + s_nationkey FROM supplier UNION SELECT 4, {C} + o_custkey, {O} + o_orderkey FROM orders
UNION SELECT 5, {O} + l_orderkey, {P} + l_partkey FROM lineitem UNION SELECT 6, {S} + l_suppkey, {P} + l_partkey FROM lineitem UNION SELECT 7, {S} + l_suppkey, {P} + l_partkey FROM lineitem UNION SELECT 7, {P} + l_partkey, {S} + l_suppkey FROM lineitem)"""


@query("digest_counts", f"WITH {EVERY_EDGE} SELECT 'edges' AS what, count(*) AS n FROM e UNION ALL SELECT 'out_degrees', count(DISTINCT (t, a)) FROM e UNION ALL SELECT 'in_degrees', count(DISTINCT (t, b)) FROM e")
def digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest(view(spark, sf_dir))
    return spark.createDataFrame([(k, d[k]) for k in ("edges", "out_degrees", "in_degrees")], "what string, n long")


@query("verified", "SELECT 'ok' AS what, 1::BIGINT AS n UNION ALL SELECT 'broken: vertices', count(*) FROM supplier UNION ALL SELECT 'broken: uneven', 0 UNION ALL SELECT 'ends without vertex', 1")
def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir)
    few = Engine(g)
    few.write(f"CREATE (a {{id: {R}}})-[:NEAR]->(b {{id: 99}})")
    small = few.graph.replaced(relationships=few.graph.relationships.filter("edge_type in ('IN_REGION', 'NEAR', 'BASED_IN')"))
    broken = verify(small.replaced(vertices=small.vertices.unionAll(small.vertices.filter("labels[0] = 'Supplier'"))))
    good = verify(small)
    return spark.createDataFrame([("ok", int(good.ok)), ("broken: vertices", broken.duplicate_vertices), ("broken: uneven", broken.uneven_types), ("ends without vertex", good.endpoints_without_vertex)], "what string, n long")


# what a statement comes to: a value, or the name of the error


def outcomes(name: str, cases: Mapping[str, tuple[Callable[[Engine], object], str]]) -> None:
    """(case, outcome) of calls on the view: what str() makes of the value, or the error's class."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for case, (call, _) in cases.items():
            try:
                rows.append((case, str(call(Engine(view(spark, sf_dir))))))
            except QueryError as e:
                rows.append((case, type(e).__name__))
        return spark.createDataFrame(rows, "case string, outcome string")

    QUERIES[name] = run
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in (case, want))) for case, (_, want) in cases.items())
    ORACLE_SQL[name] = f'SELECT * FROM (VALUES {values}) t("case", outcome)'


def reads(*statements: str, error: str = "Unsupported") -> dict:
    return {t: ((lambda e, t=t: e.read(t)), error) for t in statements}


def writes(*statements: str, error: str = "Unsupported") -> dict:
    return {t: ((lambda e, t=t: e.write(t)), error) for t in statements}


outcomes("refused_predicates", reads("MATCH (p:Part) WHERE p.size IN [1] RETURN p.id", "MATCH (p:Part) WHERE p.name CONTAINS 'x' RETURN p.id", "MATCH (p:Part) WHERE p.name ENDS WITH 'x' RETURN p.id", "MATCH (p:Part) WHERE p.size IS NULL RETURN p.id", "MATCH (p:Part) WHERE p.size = 1 XOR p.size = 2 RETURN p.id", "MATCH (p:Part) WHERE p.name RETURN p.id"))
outcomes("refused_projections", reads("MATCH (p:Part) RETURN *", "MATCH (p:Part) RETURN p", "MATCH (p:Part) RETURN 1 AS x", "MATCH (p:Part) RETURN p.size + 1 AS x"))
outcomes("refused_aggregates", reads("MATCH (p:Part) RETURN min(p.size)", "MATCH (p:Part) RETURN max(p.size)", "MATCH (p:Part) RETURN count(DISTINCT p.size)", "MATCH (p:Part) RETURN count(DISTINCT *)", "MATCH (p:Part) RETURN percentileCont(p.size, 0.5)"))
outcomes("refused_patterns", reads("MATCH (a)-[:SUPPLIES|TRADES]->(b) RETURN a.id", "MATCH (a)-[]->(b) RETURN a.id", "MATCH (a)-[:SUPPLIES]-(b) RETURN a.id", "MATCH (a {id: 1})-[:TRADES*1..2 {x: 1}]->(b) RETURN b.id", "MATCH (a {id: 1})-[:TRADES*1..]->(b) RETURN b.id", "MATCH (a:Supplier)-[:TRADES*1..2]->(b) RETURN b.id"))
outcomes("refused_unions", reads("MATCH (p:Part) RETURN p.id AS a UNION MATCH (p:Part) RETURN p.id AS b", "MATCH (p:Part) RETURN p.id AS a UNION MATCH (p:Part) RETURN p.id AS a UNION ALL MATCH (p:Part) RETURN p.id AS a"))
outcomes("refused_writes", writes("OPTIONAL MATCH (p:Part) SET p.a = 1", "MATCH (p:Part) SET p.a = 1 RETURN p.id", "MATCH (p:Part) SET p = 1", "CREATE (a {id: 1})-[:T]->(b {id: 2}) RETURN a.id"))
outcomes(
    "errors_by_kind",
    reads("MATCH (p:Part) WHERE p.size < 'x' RETURN p.id", "MATCH (p:Part) WHERE p.key = 1 OR p.size < 'x' RETURN p.id", "MATCH (p:Part) RETURN q.id", error="QueryError") | reads("MATCH (p:Part WHERE RETURN", error="ParseError") | reads("MATCH (p:Part) WHERE p.key = $k RETURN p.id", error="MissingParameter")
    | writes(f"MATCH (n {{id: {N}}}) DELETE n", error="Conflict") | writes("MATCH (p:Part) SET p.size = 'x'", error="QueryError"),
)
outcomes(
    "path_options",
    reads(*(f"CALL algo.{k}({{{c}}}) YIELD path RETURN path" for k, c in (("SPpaths", "sourceNode: 1, targetNode: 2, relTypes: ['T'], colour: 1"), ("SPpaths", "sourceNode: 1, targetNode: 2, relTypes: ['T'], pairwise: true"), ("SSpaths", "sourceNode: 1, targetNode: 2, relTypes: ['T']"), ("SSpaths", "sourceNode: 1, relTypes: []"))))
    | reads("CALL algo.SPpaths({targetNode: 2, relTypes: ['T']}) YIELD path RETURN path", error="MissingParameter") | reads("CALL algo.SSpaths({sourceNode: 1, relTypes: ['T'], maxLen: 17}) YIELD path RETURN path", error="LimitExceeded"),
)

FOUR = f"MATCH (s {{id: {S}}})-[:TRADES*1..4]->(v) RETURN v.id AS v"


def bounded(text: str, **limits: object) -> Callable[[Engine], object]:
    return lambda e: len(Engine(e.graph, limits=Limits(**limits)).rows(text))


outcomes(
    "limits",
    {
        "rows": (bounded("MATCH (n:Nation) RETURN n.id", rows=24), "LimitExceeded"), "rows that fit": (bounded("MATCH (n:Nation) RETURN n.id", rows=25), "25"),
        "rows of an arm": (bounded("MATCH (n:Nation) RETURN n.id AS i UNION MATCH (n:Nation) RETURN n.id AS i", rows=24), "LimitExceeded"), "arms that fit": (bounded("MATCH (n:Nation) RETURN n.id AS i UNION MATCH (n:Nation) RETURN n.id AS i", rows=25), "25"),
        "edges": (bounded("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.id", edges=24), "LimitExceeded"), "edges that fit": (bounded("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.id", edges=25), "25"),
        "intermediate": (bounded(FOUR, intermediate=1), "LimitExceeded"), "hops": (bounded(FOUR, hops=3), "LimitExceeded"), "seconds": (bounded("MATCH (o)-[r:CONTAINS]->(p) RETURN r.flag, count(*)", seconds=0.0001), "LimitExceeded"),
    },
)
outcomes(
    "text_helpers",
    {
        "shape": (lambda e: shape("MATCH (n {id: 5}) /* c */ RETURN  n.id"), "MATCH ( n { id : ? } ) RETURN n . id"), "same fingerprint": (lambda e: fingerprint("MATCH (n {id: 5}) RETURN n.id") == fingerprint("MATCH (n {id: 77})  RETURN n.id"), "True"),
        "other fingerprint": (lambda e: fingerprint("MATCH (n {id: 5}) RETURN n.id") == fingerprint("MATCH (n {id: $p}) RETURN n.id"), "False"), "read": (lambda e: e.access("MATCH (n:Part) RETURN n.id"), "read"), "write": (lambda e: e.access("MATCH (n:Part) SET n.a = 1"), "write"),
        "explained": (lambda e: explain(e, f"MATCH (s {{id: {S}}})-[:SUPPLIES]->(p) RETURN p.id").splitlines()[0], "arm 0 (s)-[:SUPPLIES]->(p): expand out"),
    },
)

FEATURE = """Feature: regions
  Scenario: ordered
    When executing query:
      \"\"\"
      MATCH (r:Region) RETURN r.key AS k ORDER BY k LIMIT 2
      \"\"\"
    Then the result should be, in order:
      | k |
      | 0 |
      | 1 |
  Scenario: wrong
    When executing query:
      \"\"\"
      MATCH (r:Region) RETURN count(*) AS n
      \"\"\"
    Then the result should be, in any order:
      | n |
      | 6 |
  Scenario: beyond the subset
    When executing query:
      \"\"\"
      MATCH (r) RETURN r
      \"\"\"
    Then the result should be, in any order:
      | r |
      | 1 |
"""


@query("feature_file", "SELECT * FROM (VALUES ('ordered', 'passed'), ('wrong', 'failed'), ('beyond the subset', 'skipped')) t(name, status)")
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(o.name, o.status) for o in run_features(Engine(view(spark, sf_dir)), FEATURE)], "name string, status string")


@query("users_of_events", f"SELECT DISTINCT {U} + user_id AS id FROM events")
def users_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(view(spark, sf_dir)).read("MATCH (u:User) RETURN u.id AS id")
