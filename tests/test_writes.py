"""Writes, batches, bulk loads, legs, statistics and helpers over small graphs."""

import json

import pytest

from graphloom.engine import Engine
from graphloom.errors import Conflict, QueryError, Unsupported
from graphloom.functions import stats
from graphloom.functions.text import explain, fingerprint, run_features, shape
from graphloom.functions.verify import digest, verify
from graphloom.operators import bulk, points
from graphloom.operators.legs import Leg, cheapest_first, inner_join, run_legs, run_many, union_all
from graphloom.operators.mutate import Ledger
from graphloom.operators.statements import CreateEdge, MatchEdge, MatchOut, MatchOutFiltered, MatchReachable
from graphloom.sources.graph import empty, from_frames, from_jsonl, from_rows, load
from graphloom.sources.sinks import iterate, json_body


def rel(t, s, d, rid=None, **props):
    return {"type": t, "src": s, "dst": d, "id": rid, **props}


def got(e, text, **params):
    return [tuple(r) for r in e.read(text, params).collect()]


# Statements of the supported forms; graphs and results are small enough to see.
def test_create_merge_and_parallel_relationships(spark):
    e = Engine(empty(spark))
    e.write("CREATE (a:User {id: 1, name: 'x'})-[:FOLLOWS {rank: 7}]->(b {id: 2})")
    e.write("CREATE (a {id: 1})-[:FOLLOWS {rank: 9}]->(b {id: 2})")
    assert got(e, "MATCH (a:User {name: 'x'})-[r:FOLLOWS]->(b) RETURN r.rank AS r ORDER BY r") == [(7,), (9,)]
    assert e.write("MERGE (a {id: 1})-[:FOLLOWS]->(b {id: 2})").noops == 1
    assert e.write("MERGE (a {id: 1})-[:LIKES]->(b:User {id: 2})").created == 1
    assert e.write("MERGE (a {id: 1})-[:LIKES]->(b {id: 2})").noops == 1
    assert got(e, "MATCH (a {id: 1})-[:LIKES]->(b:User) RETURN b.id") == [(2,)]
    assert e.write("CREATE (a {id: 1})-[:N]->(b {id: 2}), (a {id: 1})-[:N]->(b {id: 3})").created == 2
    assert e.write("CREATE (a {id: 1})-[:N]->(b {id: 2}), (a {id: 1})-[:N]->(b {id: 4})").created == 1
    before = e.graph
    assert e.write("MATCH (a {id: 1})-[r:FOLLOWS]->(b) WHERE r.rank = 7 SET r.seen = true").updated == 1
    assert e.write("MATCH (a {id: 1})-[r:FOLLOWS]->(b) WHERE r.rank = 7 DELETE r").deleted == 1
    assert got(e, "MATCH (a {id: 1})-[r:FOLLOWS]->(b) RETURN r.rank") == [(9,)]
    assert len(got(Engine(before), "MATCH (a {id: 1})-[r:FOLLOWS]->(b) RETURN r.rank")) == 2  # the old snapshot stays
    assert verify(e.graph).ok


def test_set_remove_and_delete(spark):
    g = from_rows(spark, [{"id": 1, "labels": ["User"], "a": 1}, {"id": 2, "labels": ["User", "Old"], "a": 2}], [rel("F", 1, 2, None), rel("F", 1, 3, 5, w=1.5)])
    e = Engine(g)
    r = e.write("MATCH (n:User) SET n.a = 2, n.b = 'x', n:Seen")
    assert (r.matched, r.updated) == (2, 2)
    assert e.write("MATCH (n:User) SET n.a = 2").noops == 2
    assert got(e, "MATCH (n:Seen) RETURN n.id AS i, n.a AS a, n.b AS b ORDER BY i") == [(1, 2, "x"), (2, 2, "x")]
    e.write("MATCH (n:Old) REMOVE n:Old, n.b")
    assert got(e, "MATCH (n:Old) RETURN n.id") == [] and got(e, "MATCH (n {id: 2}) RETURN n.b") == [(None,)]
    e.write("MATCH (a)-[:F]->(b {id: 3}) SET b.c = 1, b:New")  # an endpoint without a vertex
    assert got(e, "MATCH (b:New {c: 1}) RETURN b.id") == [(3,)]
    with pytest.raises(Conflict):
        e.write("MATCH (n:User {id: 2}) DELETE n")
    with pytest.raises(QueryError):
        e.write("MATCH (n:User) SET n.a = 'text'")
    assert e.write("MATCH (n:User {id: 2}) DETACH DELETE n").deleted == 1
    assert got(e, "MATCH (a)-[:F]->(b) RETURN b.id") == [(3,)]
    with pytest.raises(Unsupported):
        e.write("MATCH (a)-[r:F]->(b) SET r:Label")


def test_deleting_a_bare_edge_takes_its_records(spark):
    e = Engine(from_rows(spark, [], [rel("F", 1, 2, None), rel("F", 1, 2, 4, w=1), rel("F", 1, 3, 5, w=2)]))
    e.write("MATCH (a {id: 1})-[r:F]->(b {id: 2}) DELETE r")
    assert got(e, "MATCH (a)-[r:F]->(b) RETURN b.id") == [(3,)]


def test_idempotency_key(spark):
    e = Engine(empty(spark))
    first = e.write("CREATE (a {id: 1})-[:T]->(b {id: 2})", key="k")
    assert e.write("CREATE (a {id: 1})-[:T]->(b {id: 2})", key="k") == first
    assert got(e, "MATCH (a)-[:T]->(b) RETURN count(*)") == [(1,)]
    with pytest.raises(Conflict):
        e.write("CREATE (a {id: 1})-[:T]->(b {id: 3})", key="k")


def test_idempotency_key_outlives_the_engine(spark, tmp_path):
    text = "CREATE (a {id: 1})-[:T]->(b {id: 2})"
    first = Engine(empty(spark), ledger=Ledger(str(tmp_path), spark)).write(text, key="k")
    later = Engine(empty(spark), ledger=Ledger(str(tmp_path), spark))
    assert later.write(text, key="k") == first and later.graph.version == 0
    with pytest.raises(Conflict):
        later.write("CREATE (a {id: 1})-[:T]->(b {id: 3})", key="k")


def test_batches(spark):
    e = Engine(from_rows(spark, [{"id": i, "labels": ["P"]} for i in (1, 2, 3)], [rel("T", 1, 2), rel("T", 1, 3, 1), rel("T", 1, 3, 2)]))
    run = lambda text, rows: e.write("UNWIND $rows AS row " + text, {"rows": rows})
    rows = e.rows("UNWIND $rows AS row MATCH (a {id: row.x})-[:T]->(b) RETURN row.x, b.id", {"rows": [{"x": 1}, {"x": 9}, {"x": 1}]})
    assert sorted(tuple(r) for r in rows) == [(1, 2), (1, 2), (1, 3), (1, 3)]
    assert run("CREATE (a {id: row.x})-[:T]->(b {id: row.y})", [{"x": 1, "y": 2}, {"x": 7, "y": 8}]).created == 1
    assert run("MATCH (s:P {id: row.x}), (d:P {id: row.y}) CREATE (s)-[:U]->(d)", [{"x": 1, "y": 2}, {"x": 1, "y": 8}]).created == 1
    assert run("MATCH (s {id: row.x}), (d {id: row.y}) CREATE (s)-[:W {id: row.rid, k: row.k}]->(d)", [{"x": 1, "y": 2, "rid": 5, "k": "a"}] * 2).created == 2
    assert got(e, "MATCH (a)-[r:W]->(b) RETURN r.k, count(*)") == [("a", 2)]
    up = "MATCH (s {id: row.x}), (d {id: row.y}) MERGE (s)-[r:M {id: row.rid}]->(d) SET r.v = row.v"
    assert run(up, [{"x": 1, "y": 2, "rid": 50, "v": 1}]).created == 1
    assert run(up, [{"x": 1, "y": 2, "rid": 50, "v": 2}]).updated == 1
    assert got(e, "MATCH (a)-[r:M]->(b) RETURN r.v") == [(2,)]
    r = run("MERGE (n {id: row.v}) SET n:Q, n.p = row.p", [{"v": 1, "p": "x"}, {"v": 30, "p": "y"}])
    assert (r.created, r.updated) == (1, 1)
    assert got(e, "MATCH (n:Q) RETURN n.id AS i, n.p AS p ORDER BY i") == [(1, "x"), (30, "y")]
    assert run("MATCH ()-[r:W {k: row.k}]->() DELETE r", [{"k": "a"}, {"k": "a"}]).deleted == 2
    assert run("MATCH (a {id: row.x})-[r:T]->(b {id: row.y}) DELETE r", [{"x": 1, "y": 3}]).deleted == 2
    with pytest.raises(Conflict):
        run("MATCH (n {id: row.v}) DELETE n", [{"v": 1}])
    assert run("MATCH (n {id: row.v}) DETACH DELETE n", [{"v": 1}]).deleted == 1
    for bad in ("MATCH (n {id: row.v}) SET n.x = 1", "MERGE (n {id: row.v}) SET n.p = 1", "CREATE (a {id: 1})-[:T]->(b {id: row.y})"):
        with pytest.raises(QueryError):
            run(bad, [{"v": 1, "y": 2}])


def test_a_small_write_leaves_the_table_where_it_is(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "array('P') as labels", "id as p_x").write.parquet(str(tmp_path / "v"))
    e = Engine(from_frames(spark.read.parquet(str(tmp_path / "v")), empty(spark).relationships))
    r = e.write("UNWIND $rows AS row MERGE (n {id: row.i}) SET n.x = row.x", {"rows": [{"i": 5, "x": 7}, {"i": 9, "x": 9}, {"i": 30_000, "x": 1}]})
    assert (r.created, r.updated, r.noops) == (1, 1, 1) and e.graph.vertices.count() == 20_001
    assert got(e, "MATCH (n {id: 5}) RETURN n.x") == [(7,)] and got(e, "MATCH (n {id: 30000}) RETURN n.x") == [(1,)] and got(e, "MATCH (n {id: 6}) RETURN n.x") == [(6,)]
    plan = e.graph.vertices._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan and "BroadcastHashJoin" in plan


def test_guarded_batches(spark):
    e = Engine(from_rows(spark, [{"id": 1, "labels": ["P"], "ver": 5, "p": "old", "born": "a"}, {"id": 2, "labels": ["P"], "p": "no guard"}], []))
    text = "UNWIND $rows AS row MERGE (n {id: row.v}) SET n:P, n.ver = row.ver, n.p = row.p, n.born = row.born, n.__update_if_newer_by = 'ver', n.__create_only_born = true"
    rows = [{"v": 1, "ver": 5, "p": "same", "born": "z"}, {"v": 2, "ver": 1, "p": "new", "born": "z"}, {"v": 3, "ver": 1, "p": "n1", "born": "first"}, {"v": 3, "ver": 2, "p": "n2", "born": "second"}]
    r = e.write(text, {"rows": rows})
    assert (r.created, r.updated, r.noops) == (1, 1, 1)
    q = "MATCH (n:P) RETURN n.id AS i, n.ver AS v, n.p AS p, n.born AS b ORDER BY i"
    assert got(e, q) == [(1, 5, "old", "a"), (2, 1, "new", None), (3, 2, "n2", "first")]
    e.write(text, {"rows": [{"v": 1, "ver": 6, "p": "newer", "born": "z"}]})
    assert got(e, q)[0] == (1, 6, "newer", "a")
    with pytest.raises(QueryError):
        e.write(text, {"rows": [{"v": 1, "ver": "text", "p": "x", "born": "z"}]})
    with pytest.raises(Unsupported):
        e.write("UNWIND $rows AS row MERGE (n {id: row.v}) SET n.p = row.p, n.__create_only_p = true", {"rows": []})


def test_points_and_statements(spark):
    e = Engine(from_rows(spark, [{"id": 2, "labels": ["A"], "x": 1}, {"id": 3, "labels": ["B"], "x": 2}], [rel("T", 1, 3), rel("T", 1, 2, 1), rel("T", 1, 2, 2), rel("T", 2, 1)]))
    g = e.graph
    assert points.edge_exists(g, "T", 1, 2) and not points.edge_exists(g, "T", 3, 1)
    assert [r.id for r in points.out_neighbors(g, "T", 1).collect()] == [2, 3] and [r.id for r in points.in_neighbors(g, "T", 1).collect()] == [2]
    wanted = spark.createDataFrame([(0, 1), (1, 9), (2, 1)], "n long, id long")
    assert [tuple(r) for r in points.out_neighbors_batch(g, "T", wanted).orderBy("n").collect()] == [(0, 1, [2, 3]), (1, 9, []), (2, 1, [2, 3])]
    assert [r.neighbors for r in points.in_neighbors_batch(g, "T", wanted).orderBy("n").collect()] == [[2], [], [2]]
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "n long, src long, dst long")
    assert [r["exists"] for r in points.edge_exists_batch(g, "T", pairs).orderBy("n").collect()] == [True, False]
    assert MatchOut("T", 1, return_count=True).run(e).first().degree == 2
    assert [r.id for r in MatchOutFiltered("T", 1, ("A",), (("x", ">", 0),)).run(e).collect()] == [2]
    assert MatchEdge("T", 1, 3).run(e)
    assert MatchReachable("T", 1, 1, 2, return_count=True).run(e).first()[0] == 3
    CreateEdge("T", 3, 4, props=(("w", 1),)).run(e)
    assert MatchEdge("T", 3, 4).run(e)


def test_bulk(spark):
    g = empty(spark)
    edges = spark.createDataFrame([("T", 1, 2), ("T", 2, 3)], "edge_type string, src long, dst long")
    g, r = bulk.import_edges(g, edges)
    assert r.created == 2 and bulk.import_edges(g, edges)[1].noops == 2
    with pytest.raises(Conflict):
        bulk.import_edges(g, edges.unionAll(edges))
    g, _ = bulk.import_relationships(g, edges.selectExpr("*", "1.5D as p_w"))
    g, _ = bulk.import_vertices(g, spark.createDataFrame([(1, ["X"], "n")], "id long, labels array<string>, p_name string"))
    assert got(Engine(g), "MATCH (a:X)-[r:T {w: 1.5}]->(b) RETURN b.id, a.name") == [(2, "n")]
    changes = spark.createDataFrame([("put", 1, "T", 5, 6), ("delete", 2, "T", 5, 6), ("delete", 1, "T", 1, 2), ("put", 3, "T", 7, 8)], "op string, seq long, edge_type string, src long, dst long")
    g2 = bulk.ingest(g, changes)
    assert {(r.src, r.dst) for r in g2.edges("T").collect()} == {(2, 3), (7, 8)}
    assert bulk.delete_edges(g2, edges)[1].deleted == 2
    assert bulk.drop_type(g2, "T").relationships.isEmpty()


def test_stream_of_changes(spark, tmp_path):
    from graphloom.streaming.ingest import ingest_stream

    schema = "op string, seq long, edge_type string, src long, dst long"
    spark.createDataFrame([("put", 1, "T", 1, 2), ("put", 2, "T", 2, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest_stream(stream, str(tmp_path / "g"), str(tmp_path / "c"), empty(spark)).awaitTermination()
    assert load(spark, str(tmp_path / "g"), 1).edges("T").count() == 2


def test_legs(spark):
    a = Engine(from_rows(spark, [{"id": 1, "labels": ["U"], "k": "x"}, {"id": 2, "labels": ["U"]}], []))
    b = Engine(from_rows(spark, [{"id": 7, "labels": ["U"], "k": "x"}, {"id": 8, "labels": ["U"], "z": 1}], []))
    q = "MATCH (u:U) RETURN u.id AS id, u.k AS k"
    legs = run_legs({"a": a, "b": b}, [Leg("l", "a", q), Leg("r", "b", q)])
    assert sorted(r.id for r in union_all(legs).collect()) == [1, 2, 7, 8]
    joined = inner_join(legs, "l", "k", "r", "k")
    assert joined.columns == ["l.id", "l.k", "r.id", "r.k"]
    assert sorted((r[0], r[2]) for r in joined.collect()) == [(1, 7), (2, 8)]  # NULL meets NULL
    assert list(cheapest_first({"big": a.read(q), "none": a.read("MATCH (u:Absent) RETURN u.id AS id, u.k AS k LIMIT 0")})) == ["none", "big"]
    assert {k: v.count() for k, v in run_many({"a": a, "b": b}, q).items()} == {"a": 2, "b": 2}
    with pytest.raises(QueryError):
        union_all({"l": legs["l"], "x": a.read("MATCH (u:U) RETURN u.id AS other")})


def test_statistics_and_digest(spark, tmp_path):
    g = from_rows(spark, [{"id": 1, "labels": ["A", "B"], "x": 1}, {"id": 2, "labels": ["A"], "x": 1}, {"id": 3, "labels": []}], [rel("T", 1, 2, 1, w=1), rel("T", 1, 2, 2, w=1), rel("U", 1, 3)])
    assert {tuple(r) for r in stats.edge_type_counts(g).collect()} == {("T", 2, 1), ("U", 1, 1)}
    assert {tuple(r) for r in stats.label_counts(g).collect()} == {("A", 2), ("B", 1)}
    assert {tuple(r) for r in stats.property_counts(g).collect()} == {("x", 2)}
    assert tuple(stats.summary(stats.vertex_histogram(g, "x")).first()) == (2, 1, 2)
    assert tuple(stats.summary(stats.edge_histogram(g, "T", "w")).first()) == (2, 1, 2)
    again = from_rows(spark, [], [rel("U", 1, 3), rel("T", 1, 2)])
    assert digest(g) == digest(again) and digest(g)["edges"] == 2
    rows = {tuple(r) for r in stats.refresh(g, str(tmp_path)).collect()}
    assert rows == {tuple(r) for r in stats.collected(g).collect()} and ("label", "A", 2) in rows and ("relationship_property", "w", 2) in rows
    assert {tuple(r) for r in stats.refresh(g.replaced(vertices=g.vertices.limit(0)), str(tmp_path)).collect()} != rows
    assert {tuple(r) for r in stats.refresh(g, str(tmp_path)).collect()} == rows
    broken = g.replaced(vertices=g.vertices.unionAll(g.vertices))
    assert verify(g).ok and not verify(broken).ok


def test_text_helpers(spark):
    assert shape("MATCH (n {id: 5}) /* c */ RETURN  n.id // x") == shape("MATCH (n {id: 77})\nRETURN n.id")
    assert fingerprint("MATCH (n {id: 5}) RETURN n.id") != fingerprint("MATCH (n {id: $x}) RETURN n.id")
    e = Engine(from_rows(spark, [{"id": 1, "labels": ["User"], "name": "a"}], [rel("T", 1, 2)]))
    out = explain(e, "MATCH (u:User)-[:T]->(v) RETURN v.id")
    assert "type scan" in out and "Physical Plan" in out
    feature = '''
Feature: x
  Scenario: one
    When executing query:
      """
      MATCH (u:User)-[:T]->(v) RETURN u.name AS n, v.id AS v
      """
    Then the result should be, in any order:
      | n   | v |
      | 'a' | 2 |
  Scenario: unsupported
    When executing query:
      """
      MATCH (n) RETURN n
      """
    Then the result should be, in order:
      | n |
      | 1 |
  Scenario: wrong
    When executing query:
      """
      MATCH (u:User) RETURN u.id AS i
      """
    Then the result should be, in order:
      | i |
      | 2 |
'''
    assert [o.status for o in run_features(e, feature)] == ["passed", "skipped", "failed"]
    assert json.loads(json_body(e.read("MATCH (u:User) RETURN u.id AS i"), 5)) == {"columns": ["i"], "rows": [[1]]}
    assert list(iterate(e.read("MATCH (u:User) RETURN u.id AS i"))) == [{"i": 1}]


def test_jsonl_dump(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"graph": "g", "node_count": 2, "edge_count": 1}))
    nodes = [{"id": 1, "labels": ["A"], "properties": {"n": 1, "f": 2.5, "s": "x", "b": True, "l": [1], "m": None}}, {"id": 2, "labels": [], "properties": {"n": 2, "f": 3}}]
    (tmp_path / "nodes.jsonl").write_text("\n".join(map(json.dumps, nodes)))
    (tmp_path / "edges.jsonl").write_text(json.dumps({"id": 9, "type": "T", "source_id": 1, "target_id": 2, "properties": {"w": 4}}))
    e = Engine(from_jsonl(spark, str(tmp_path)))
    assert got(e, "MATCH (a:A)-[r:T]->(b) RETURN a.n, a.f, a.s, a.b, a.l, a._fid, r.w, b.f") == [(1, 2.5, "x", True, "[1]", 1, 4, 3.0)]
    (tmp_path / "manifest.json").write_text(json.dumps({"graph": "g", "node_count": 3}))
    with pytest.raises(QueryError):
        from_jsonl(spark, str(tmp_path))
