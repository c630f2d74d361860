"""Queries of the graph engine over the table view, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import stats
from graphloom.operators import points
from graphloom.operators.legs import inner_join, union_all
from graphloom.operators.paths import NO_LIMIT
from graphloom.operators.reach import bfs
from graphloom.sources.graph import OFFSETS, Graph, from_rows, from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

R, N, C, S, P, O, U = (OFFSETS[k] for k in ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User"))  # noqa: E741


_VIEWS: dict[tuple[str, str], Graph] = {}


def view(spark: SparkSession, sf_dir: str) -> Graph:
    """The table view of a folder: its plan is analysed once per application, its data are not kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VIEWS:
        _VIEWS[key] = from_tables(spark, sf_dir)
    return _VIEWS[key]


def text(name: str, statement: str, sql: str | None = None, **params: object) -> None:
    """Register a statement over the table view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(view(spark, sf_dir)).read(statement, params)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# fixed parts of the SQL twins
CUST, ORD, LINE = f"{C} + c_custkey", f"{O} + o_orderkey", "lineitem"
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

text(
    "graph_top_customers",
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total_cents > 10000000 RETURN c.id AS c, count(*) AS n, sum(o.total_cents) AS cents ORDER BY n DESC, c LIMIT 10",
    f"SELECT {C} + o_custkey AS c, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents FROM orders WHERE {CENTS} > 10000000 GROUP BY 1 ORDER BY n DESC, c LIMIT 10",
)
text("node_label_scan", "MATCH (s:Supplier) RETURN s.id AS id, s.name AS name", f"SELECT {S} + s_suppkey AS id, s_name AS name FROM supplier")
text("node_id_seek", f"MATCH (c {{id: {C + 7}}}) RETURN c.id AS id, c.name AS name", f"SELECT {C + 7} AS id, (SELECT c_name FROM customer WHERE c_custkey = 7) AS name")
text("node_id_seek_absent", "MATCH (c {id: 404}) RETURN c.id AS id, c.name AS name", "SELECT 404::BIGINT AS id, NULL::VARCHAR AS name")
text("node_property_eq", "MATCH (p:Part {brand: 'Brand#11'}) RETURN p.key AS key, p.size AS size", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand = 'Brand#11'")
text("starts_with_prefix", "MATCH (c:Customer) WHERE c.name STARTS WITH $p RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE c_name LIKE 'Customer#00000001%'", p="Customer#00000001")
text("where_compare", "MATCH (o:Order) WHERE o.status = 'F' AND NOT (o.total_cents <= 5000000 OR o.priority STARTS WITH '5') RETURN o.key AS key", f"SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND NOT ({CENTS} <= 5000000 OR o_orderpriority LIKE '5%')")
text("where_not_missing", "MATCH (n:Customer) WHERE NOT (n.brand = 'x') AND NOT (n.segment = 'BUILDING') RETURN n.key AS key", "SELECT c_custkey AS key FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)")
text("where_chained", "MATCH (p:Part) WHERE 10 < p.size <= 20 RETURN p.key AS key, p.size AS size", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 10 AND p_size <= 20")
text("where_property_pair", "MATCH (c:Customer)-[:LIVES_IN]->(n)<-[:BASED_IN]-(s:Supplier) WHERE s.acctbal > c.acctbal RETURN c.key AS c, s.key AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal")
text("one_hop_out", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.key AS c, n.name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
text("one_hop_in", "MATCH (n:Nation {name: 'NATION_15'})<-[:LIVES_IN]-(c) RETURN c.id AS c", f"SELECT {CUST} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_15'")
text("edge_property_filter", "MATCH (o)-[r:CONTAINS {flag: 'R'}]->(p) WHERE r.qty >= 45 RETURN o.id AS o, p.id AS p, r.ext_cents AS cents", f"SELECT {O} + l_orderkey AS o, {P} + l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) >= 45")
text("edge_predicate_list", "MATCH (o)-[r:CONTAINS]->(p) WHERE r.line = 1 OR r.line = 7 RETURN r.line AS line, count(*) AS n", "SELECT CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 7) GROUP BY 1")
text(
    "multi_match_join", "MATCH (c:Customer)-[:PLACED]->(o) MATCH (o)-[r:CONTAINS]->(p:Part) WHERE p.size = 15 RETURN c.key AS c, p.key AS p, r.qty AS qty",
    "SELECT o_custkey AS c, p_partkey AS p, CAST(l_quantity AS BIGINT) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 15",
)
text(
    "multi_edge_path", "MATCH (r:Region)<-[:IN_REGION]-()<-[:LIVES_IN]-(c)-[:PLACED]->(o:Order) RETURN r.name AS region, o.priority AS priority, count(*) AS n",
    "SELECT r_name AS region, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
)
text(
    "expand_into", "MATCH (s)-[:SUPPLIES]->(p), (o)-[r:CONTAINS]->(p), (c)-[:PLACED]->(o), (c)-[:LIVES_IN]->(n), (s)-[:BASED_IN]->(n) WHERE r.qty = 50 RETURN c.id AS c, s.id AS s, count(*) AS n",
    f"SELECT {C} + o_custkey AS c, {S} + s.s AS s, count(*) AS n FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) s ON s.p = l.l_partkey JOIN supplier ON s_suppkey = s.s AND s_nationkey = c_nationkey WHERE CAST(l_quantity AS BIGINT) = 50 GROUP BY 1, 2",
)
text("cross_join", "MATCH (r:Region), (n:Nation) RETURN r.key AS r, n.key AS n", "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region, nation")
text("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.key AS c, o.key AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
text("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P' AND c.segment = 'MACHINERY' RETURN c.key AS c, o.key AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND c_mktsegment = 'MACHINERY'")
text(
    "optional_group", "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES]->(p:Part {size: 1}), (s)-[:BASED_IN]->(n:Nation {name: 'NATION_15'}) RETURN s.key AS s, p.key AS p, n.name AS n",
    "SELECT s_suppkey AS s, p AS p, n AS n FROM supplier LEFT JOIN (SELECT DISTINCT s_suppkey AS k, p_partkey AS p, n_name AS n FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = 1 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey AND n_name = 'NATION_15') ON k = s_suppkey",
)
text(
    "required_after_optional", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s) WHERE s.acctbal > 1000.0 MATCH (s)-[:SUPPLIES]->(p) RETURN n.key AS n, count(*) AS parts",
    "SELECT CAST(s_nationkey AS BIGINT) AS n, count(*) AS parts FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey WHERE s_acctbal > 1000.0 GROUP BY 1",
)
text("count_star", "MATCH (o)-[:CONTAINS]->(p) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem")
text("count_expr", "MATCH (c:Customer) RETURN count(c.segment) AS n, count(c.brand) AS none, count(1) AS every", "SELECT count(c_mktsegment) AS n, 0::BIGINT AS none, count(*) AS every FROM customer")
text("sum_int", "MATCH (o:Order) RETURN o.status AS status, sum(o.total_cents) AS cents", f"SELECT o_orderstatus AS status, CAST(sum({CENTS}) AS BIGINT) AS cents FROM orders GROUP BY 1")
text("avg_int", "MATCH (o)-[r:CONTAINS]->(p) RETURN r.flag AS flag, avg(r.qty) AS qty", "SELECT l_returnflag AS flag, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS qty FROM lineitem GROUP BY 1")
text("aggregates_of_nothing", "MATCH (o:Order {status: 'nothing'}) RETURN count(*) AS n, sum(o.total_cents) AS s, avg(o.total_cents) AS a", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::DOUBLE AS a")
text("grouped_aggregate", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS n, c.segment AS segment, count(*) AS orders, sum(o.total_cents) AS cents", f"SELECT n_name AS n, c_mktsegment AS segment, count(*) AS orders, CAST(sum({CENTS}) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
text("distinct_rows", "MATCH (o)-[r:CONTAINS]->(p) RETURN DISTINCT r.flag AS flag, r.line AS line", "SELECT DISTINCT l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS line FROM lineitem")
text(
    "order_nulls", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P' RETURN c.key AS c, o.key AS o ORDER BY o DESC, c",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' ORDER BY o DESC NULLS FIRST, c",
)
text("skip_limit", "MATCH (o:Order) RETURN o.key AS key, o.total_cents AS cents ORDER BY cents DESC, key SKIP 2 * 5 LIMIT 25", f"SELECT o_orderkey AS key, {CENTS} AS cents FROM orders ORDER BY cents DESC, key LIMIT 25 OFFSET 10")
text("topk_string", "MATCH (p:Part) WHERE p.name STARTS WITH 'b' RETURN p.name AS name, p.key AS key ORDER BY name, key LIMIT 15", "SELECT p_name AS name, p_partkey AS key FROM part WHERE p_name LIKE 'b%' ORDER BY name, key LIMIT 15")
text("order_by_hidden", "MATCH (o:Order) RETURN o.key AS key ORDER BY o.total_cents, o.id LIMIT 20", f"SELECT o_orderkey AS key FROM orders ORDER BY {CENTS}, o_orderkey LIMIT 20")
text("union_distinct", "MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN n.id AS n UNION MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.id AS n", f"SELECT {N} + c_nationkey AS n FROM customer UNION SELECT {N} + s_nationkey FROM supplier")
text("union_all", "MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN n.id AS n UNION ALL MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.id AS n", f"SELECT {N} + c_nationkey AS n FROM customer UNION ALL SELECT {N} + s_nationkey FROM supplier")
text("union_windowed", "MATCH (c:Customer) RETURN c.key AS k ORDER BY k DESC LIMIT 3 UNION ALL MATCH (c:Customer) RETURN c.key AS k ORDER BY k LIMIT 2", "(SELECT c_custkey AS k FROM customer ORDER BY k DESC LIMIT 3) UNION ALL (SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 2)")
text("with_pass_through", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, c MATCH (n)<-[:BASED_IN]-(s) WHERE c.acctbal > 9000.0 RETURN c.key AS c, s.id AS s", f"SELECT c_custkey AS c, {S} + s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000.0")
text("parallel_relationships", "MATCH (o:Order)-[r:CONTAINS]->(p) RETURN o.key AS o, p.id AS p, count(*) AS n ORDER BY n DESC, o, p", f"SELECT l_orderkey AS o, {P} + l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2")

HOPS = f"""t AS (SELECT DISTINCT l_suppkey + {S} AS s, l_partkey + {P} AS p FROM lineitem), e AS (SELECT s AS a, p AS b FROM t UNION ALL SELECT p, s FROM t),
h1 AS (SELECT DISTINCT b FROM e WHERE a = {S}), h2 AS (SELECT DISTINCT e.b FROM h1 JOIN e ON e.a = h1.b), h3 AS (SELECT DISTINCT e.b FROM h2 JOIN e ON e.a = h2.b)"""
text("reach_1_3", f"MATCH (s {{id: {S}}})-[:TRADES*1..3]->(v) RETURN v.id AS v", f"WITH {HOPS} SELECT b AS v FROM h1 UNION SELECT b FROM h2 UNION SELECT b FROM h3")
text("reach_exact_2", f"MATCH (s {{id: {S}}})-[:TRADES*2]->(v) RETURN v.id AS v", f"WITH {HOPS} SELECT b AS v FROM h2")
text("reach_zero", f"MATCH (s {{id: {S}}})-[:TRADES*0..1]->(v) RETURN v.id AS v", f"WITH {HOPS} SELECT b AS v FROM h1 UNION SELECT {S}::BIGINT")
text("reach_count", f"MATCH (s {{id: {S}}})-[:TRADES*1..2]->(v) RETURN count(*) AS n", f"WITH {HOPS} SELECT count(*) AS n FROM (SELECT b FROM h1 UNION SELECT b FROM h2)")
text("reach_window", f"MATCH (s {{id: {S}}})-[:TRADES*1..2]->(v) RETURN v.id AS v ORDER BY v SKIP 3 LIMIT 9", f"WITH {HOPS} SELECT v FROM (SELECT b AS v FROM h1 UNION SELECT b FROM h2) ORDER BY v LIMIT 9 OFFSET 3")
text(
    "reach_per_row", "MATCH (n:Nation {name: 'NATION_15'})<-[:BASED_IN]-(s:Supplier) MATCH (s)-[:TRADES*1..2]->(v:Supplier) RETURN s.key AS s, v.key AS v",
    "WITH t AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT DISTINCT a.s, b.s AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_name = 'NATION_15' JOIN t a ON a.s = s_suppkey JOIN t b ON b.p = a.p",
)


@query("bfs_3", f"WITH {HOPS} SELECT v FROM (SELECT b AS v FROM h1 UNION SELECT b FROM h2 UNION SELECT b FROM h3) WHERE v <> {S}")
def bfs_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir)
    return bfs(g.adjacency("TRADES"), spark.range(1).select(F.lit(S).cast("long").alias("id")), 3)


@query("collect_ids", "SELECT r_name AS r, list_sort(list(n_name)) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def collect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(view(spark, sf_dir)).read("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, collect(n.name) AS ns")
    return df.select("r", F.sort_array("ns").alias("ns"))


@query("out_neighbors_batch", f"SELECT k AS id, coalesce((SELECT list_sort(list(DISTINCT {O} + o_orderkey)) FROM orders WHERE {C} + o_custkey = k), []) AS neighbors FROM (SELECT {C} + range AS k FROM range(40))")
def out_neighbors_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.out_neighbors_batch(view(spark, sf_dir), "PLACED", spark.range(C, C + 40))


@query("in_neighbors_batch", f"SELECT k AS id, coalesce((SELECT list_sort(list(DISTINCT {C} + c_custkey)) FROM customer WHERE {N} + c_nationkey = k), []) AS neighbors FROM (SELECT {N} + range AS k FROM range(30))")
def in_neighbors_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.in_neighbors_batch(view(spark, sf_dir), "LIVES_IN", spark.range(N, N + 30))


@query("edge_exists_batch", f"""SELECT a.range + {S} AS src, b.range + {P} AS dst, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = a.range AND l_partkey = b.range) AS "exists" FROM range(10) a, range(50) b""")
def edge_exists_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.range(500).select((F.expr("id div 50") + S).alias("src"), (F.expr("id % 50") + P).alias("dst"))
    return points.edge_exists_batch(view(spark, sf_dir), "SUPPLIES", pairs)


@query("unwind_out_neighbors", f'SELECT DISTINCT {S} + l_suppkey AS "row.x", {P} + l_partkey AS "b.id" FROM lineitem WHERE l_suppkey IN (1, 3, 5)')
def unwind_out_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"x": S + i} for i in (1, 3, 5)]
    return Engine(view(spark, sf_dir)).read("UNWIND $rows AS row MATCH (a {id: row.x})-[:SUPPLIES]->(b) RETURN row.x, b.id", {"rows": rows})


@query("degree", "SELECT l_suppkey + %d AS id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1" % S)
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.degrees(view(spark, sf_dir), "SUPPLIES")


@query("legs_union_all", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def legs_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(view(spark, sf_dir))
    return union_all({v: e.read(f"MATCH (x:{v}) RETURN x.key AS k, x.name AS name") for v in ("Customer", "Supplier")})


@query("legs_inner_join", f'SELECT c_custkey AS "c.k", {N} + c_nationkey AS "c.n", s_suppkey AS "s.k", {N} + s_nationkey AS "s.n" FROM customer JOIN supplier ON c_nationkey = s_nationkey')
def legs_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(view(spark, sf_dir))
    legs = {"c": e.read("MATCH (x:Customer)-[:LIVES_IN]->(n) RETURN x.key AS k, n.id AS n"), "s": e.read("MATCH (x:Supplier)-[:BASED_IN]->(n) RETURN x.key AS k, n.id AS n")}
    return inner_join(legs, "c", "n", "s", "n")


@query("stats_histogram", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vertex_histogram(view(spark, sf_dir), "priority", "Order")


@query(
    "stats_edge_types",
    """SELECT 'PLACED' AS edge_type, count(*) AS relationships, count(DISTINCT (o_custkey, o_orderkey)) AS edges FROM orders UNION ALL
SELECT 'CONTAINS', count(*), count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(DISTINCT (l_suppkey, l_partkey)), count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem UNION ALL
SELECT 'TRADES', 2 * count(DISTINCT (l_suppkey, l_partkey)), 2 * count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem UNION ALL SELECT 'LIVES_IN', count(*), count(*) FROM customer UNION ALL
SELECT 'BASED_IN', count(*), count(*) FROM supplier UNION ALL SELECT 'IN_REGION', count(*), count(*) FROM nation""",
)
def stats_edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_type_counts(view(spark, sf_dir))


@query("stats_labels", "SELECT 'Customer' AS label, count(*) AS vertices FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
def stats_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.label_counts(view(spark, sf_dir))


# writes on the table view: the result is a read of the new snapshot


def after(name: str, statement: str, read: str, sql: str | None = None, **params: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(view(spark, sf_dir))
        e.write(statement, params)
        return e.read(read)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


after("mutate_set", "MATCH (c:Customer) WHERE c.segment = 'BUILDING' SET c.tier = 2, c:Builder", "MATCH (c:Builder) RETURN c.key AS key, c.tier AS tier", "SELECT c_custkey AS key, 2::BIGINT AS tier FROM customer WHERE c_mktsegment = 'BUILDING'")
after("mutate_set_relationship", "MATCH (c)-[r:PLACED]->(o:Order) WHERE o.status = 'P' SET r.late = true", "MATCH (c)-[r:PLACED {late: true}]->(o) RETURN o.id AS o", f"SELECT {ORD} AS o FROM orders WHERE o_orderstatus = 'P'")
after("mutate_remove", "MATCH (n:Nation) WHERE n.key < 5 REMOVE n:Nation, n.name", "MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey >= 5")
after("mutate_create", f"CREATE (a:Region {{id: {R}}})-[:NEAR {{w: 3}}]->(b {{id: {R + 1}}})", "MATCH (a:Region)-[r:NEAR]->(b:Region) RETURN a.key AS a, b.key AS b, r.w AS w", "SELECT 0::BIGINT AS a, 1::BIGINT AS b, 3::BIGINT AS w")
after("mutate_merge", f"MERGE (c {{id: {C + 1}}})-[:LIVES_IN]->(n {{id: {N + 24}}})", f"MATCH (c {{id: {C + 1}}})-[:LIVES_IN]->(n) RETURN n.key AS n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_custkey = 1 UNION SELECT 24")
after("mutate_delete", "MATCH (c)-[r:PLACED]->(o:Order) WHERE o.status = 'F' DELETE r", "MATCH (c)-[:PLACED]->(o) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
after("mutate_detach_delete", "MATCH (n:Nation) WHERE n.key < 5 DETACH DELETE n", "MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN n.id AS n, count(*) AS k", f"SELECT {N} + c_nationkey AS n, count(*) AS k FROM customer WHERE c_nationkey >= 5 GROUP BY 1")
after(
    "unwind_upsert", "UNWIND $rows AS row MERGE (n {id: row.i}) SET n:Supplier, n.name = row.name, n.rank = row.rank", "MATCH (s:Supplier) WHERE s.rank > 0 RETURN s.id AS id, s.key AS key, s.name AS name, s.rank AS rank",
    f"SELECT {S} + i AS id, CASE WHEN i < 5 THEN i END AS key, 'new' || i AS name, i + 1 AS rank FROM (SELECT unnest([0, 1, 2, 999999999])::BIGINT AS i)",
    rows=[{"i": S + i, "name": f"new{i}", "rank": i + 1} for i in (0, 1, 2, 999999999)],
)
after(
    "guarded_upsert", "UNWIND $rows AS row MERGE (n {id: row.i}) SET n.key = row.key, n.name = row.name, n.__update_if_newer_by = 'key'", "MATCH (r:Region) RETURN r.id AS id, r.key AS key, r.name AS name",
    f"SELECT {R} + r_regionkey AS id, CASE r_regionkey WHEN 1 THEN 7 ELSE r_regionkey END::BIGINT AS key, CASE r_regionkey WHEN 1 THEN 'newer' ELSE r_name END AS name FROM region",
    rows=[{"i": R, "key": 0, "name": "same"}, {"i": R + 1, "key": 7, "name": "newer"}],
)
after("unwind_create", "UNWIND $rows AS row CREATE (a {id: row.a})-[:PLACED]->(b {id: row.b})", f"MATCH (c {{id: {C + 5}}})-[:PLACED]->(o) RETURN o.id AS o", f"SELECT {ORD} AS o FROM orders WHERE o_custkey = 5 UNION SELECT 77", rows=[{"a": C + 5, "b": 77}, {"a": C + 5, "b": 77}])


# path procedures on the table view and on a small graph

PATHS = "CALL algo.{}({{{}}}) YIELD path, pathWeight, pathCost RETURN path, pathWeight, pathCost"


def flat(df: DataFrame) -> DataFrame:
    return df.select(F.transform("path.nodes", lambda n: n["id"]).alias("nodes"), "pathWeight", "pathCost")


def paths(name: str, call: str, config: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(Engine(view(spark, sf_dir)).read(PATHS.format(call, config)))
    if sql is not None:
        ORACLE_SQL[name] = sql


paths(
    "sp_paths", "SPpaths", f"sourceNode: {R}, targetNode: {C + 3}, relTypes: ['IN_REGION', 'LIVES_IN'], relDirection: 'incoming', maxLen: 3, pathCount: 0",
    f"SELECT [{R}::BIGINT, {N} + n_nationkey, {CUST}] AS nodes, 2.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 3 AND n_regionkey = 0",
)
paths(
    "ss_paths", "SSpaths", f"sourceNode: {R + 1}, relTypes: ['IN_REGION', 'LIVES_IN'], relDirection: 'incoming', maxLen: 2, resultLimit: {NO_LIMIT}",
    f"SELECT [{R + 1}::BIGINT, {N} + n_nationkey] AS nodes, 1.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM nation WHERE n_regionkey = 1 UNION ALL SELECT [{R + 1}::BIGINT, {N} + n_nationkey, {CUST}], 2.0, 0.0 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
)
paths(
    "ms_paths", "MSpaths", "sourceLabel: 'Nation', sourceProperty: 'name', sourceValues: ['NATION_0', 'NATION_5', 'NATION_6', 'NATION_11'], targetValues: ['NATION_0', 'NATION_5', 'NATION_6', 'NATION_11'], pairwise: true, relTypes: ['IN_REGION'], relDirection: 'both', maxLen: 2",
    f"SELECT [{N} + a.n_nationkey, {R} + a.n_regionkey, {N} + b.n_nationkey] AS nodes, 2.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_name IN ('NATION_0', 'NATION_5', 'NATION_6', 'NATION_11') AND b.n_name IN ('NATION_0', 'NATION_5', 'NATION_6', 'NATION_11')",
)
paths(
    "weighted_paths", "SSpaths", f"sourceNode: {O}, relTypes: ['CONTAINS', 'SUPPLIES'], relDirection: 'both', maxLen: 1, weightProp: 'qty', costProp: 'line', pathCount: 9",
    f"SELECT [{O}::BIGINT, {P} + l_partkey] AS nodes, CAST(l_quantity AS DOUBLE) AS pathWeight, CAST(l_linenumber AS DOUBLE) AS pathCost FROM lineitem WHERE l_orderkey = 0",
)


@query(
    "fair_variants",
    """WITH e(a, b, id) AS (VALUES (1::BIGINT, 2::BIGINT, 1), (1, 2, 2), (1, 2, 3), (1, 2, 4), (2, 3, 9)), s AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS structure, count(*) OVER () AS structures FROM (SELECT DISTINCT a, b FROM e)),
t AS (SELECT e.*, structure, structures, row_number() OVER (PARTITION BY e.a, e.b ORDER BY id) AS turn FROM e JOIN s ON e.a = s.a AND e.b = s.b)
SELECT [a, b] AS nodes, 1.0::DOUBLE AS pathWeight, 0.0::DOUBLE AS pathCost FROM t WHERE turn <= 3 // structures + CASE WHEN structure < 3 % structures THEN 1 ELSE 0 END""",
)
def fair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small graph of the golden test: parallel relationships of one pair do not use up the limit."""
    names = ["alpha", "beta", "gamma"]
    v = [{"id": i + 1, "labels": ["Entity"], "name": n} for i, n in enumerate(names)]
    r = [{"type": "RELATES", "src": 1, "dst": 2, "id": i} for i in range(1, 5)] + [{"type": "RELATES", "src": 2, "dst": 3, "id": 9}]
    config = f"sourceLabel: 'Entity', sourceProperty: 'name', sourceValues: {names}, targetValues: {names}, pairwise: true, relTypes: ['RELATES'], maxLen: 1, relDirection: 'both', fairRelationshipVariants: true, resultLimit: 3"
    return flat(Engine(from_rows(spark, v, r)).read(PATHS.format("MSpaths", config)))
