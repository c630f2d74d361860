"""Path procedures over small graphs, and against a plain model."""

import random

import pytest

from graphloom.cypher.parser import parse
from graphloom.engine import Engine
from graphloom.errors import LimitExceeded, QueryError
from graphloom.limits import Limits
from graphloom.operators.paths import spec
from graphloom.operators.reach import bfs, reach
from graphloom.sources.graph import from_rows


def rel(t, s, d, rid=None, **props):
    return {"type": t, "src": s, "dst": d, "id": rid, **props}


def call(kind, columns="path", **config):
    def show(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, list):
            return "[" + ", ".join(map(show, v)) + "]"
        return str(v)

    body = ", ".join(f"{k}: {show(v)}" for k, v in config.items())
    return f"CALL algo.{kind}({{{body}}}) YIELD path, pathWeight, pathCost RETURN {columns}"


def nodes(rows):
    return [[n.id for n in r.path.nodes] for r in rows]


# The small graphs of this test and the next two, whose paths are known.
def test_unweighted_single_pair(spark):
    e = Engine(from_rows(spark, [{"id": 4, "labels": ["X"], "name": "four"}], [rel("R", a, b) for a, b in ((1, 2), (1, 3), (2, 4), (3, 5), (5, 4))]))
    q = lambda **c: e.rows(call("SPpaths", "path, pathWeight", sourceNode=1, targetNode=4, relTypes=["R"], maxLen=4, **c))
    rows = q()
    assert nodes(rows) == [[1, 2, 4]] and rows[0].pathWeight == 2.0
    assert rows[0].path.nodes[2].labels == ["X"] and rows[0].path.nodes[2].props[0].v == "four"
    assert nodes(q(pathCount=0)) == [[1, 2, 4]]
    assert nodes(q(pathCount=5)) == [[1, 2, 4], [1, 3, 5, 4]]
    assert e.rows(call("SPpaths", sourceNode=1, targetNode=4, relTypes=["R"], maxLen=0)) == []
    back = e.rows(call("SPpaths", sourceNode=4, targetNode=1, relTypes=["R"], relDirection="incoming"))
    assert nodes(back) == [[4, 2, 1]]
    both = e.rows(call("SPpaths", sourceNode=2, targetNode=3, relTypes=["R"], relDirection="both"))
    assert nodes(both) == [[2, 1, 3]]


def test_paths_over_their_cost_are_not_carried_on(spark, monkeypatch):
    from graphloom.operators import paths

    edges = [rel("R", i, j, 10 * i + j, w=1, c=1 if j == i + 1 else 50) for i in range(7) for j in range(7) if i != j]
    e, sizes, kept = Engine(from_rows(spark, [], edges)), [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: (out := kept(df, name), sizes.append(out.count()) if name == "paths" else None)[0])
    q = call("SPpaths", "path, pathWeight, pathCost", sourceNode=0, targetNode=4, relTypes=["R"], weightProp="w", costProp="c", maxCost=6, maxLen=5, pathCount=9)
    assert nodes(e.rows(q)) == [[0, 1, 2, 3, 4]] and max(sizes) == 1
    free = call("SPpaths", "path, pathWeight, pathCost", sourceNode=0, targetNode=4, relTypes=["R"], weightProp="w", costProp="c", maxLen=3, pathCount=50)
    assert len(e.rows(free)) == 1 + 5 + 20
    with pytest.raises(LimitExceeded, match="in between"):
        Engine(e.graph, limits=Limits(intermediate=5)).rows(free)
    many = Engine(from_rows(spark, [], [rel("R", 1, 2, i) for i in range(9)] + [rel("R", 2, 3, i) for i in range(9)]), limits=Limits(intermediate=80))
    with pytest.raises(LimitExceeded, match="81"):  # 9 * 9 choices on one path
        many.rows(call("SPpaths", sourceNode=1, targetNode=3, relTypes=["R"], pathCount=3))


def test_weights_and_costs(spark):
    e = Engine(from_rows(spark, [], [rel("ROUTE", 1, 2, 1, w=1, c=5), rel("ROUTE", 2, 4, 2, w=1, c=5), rel("ROUTE", 1, 3, 3, w=2, c=1), rel("ROUTE", 3, 4, 4, w=2, c=1)]))
    base = dict(sourceNode=1, targetNode=4, relTypes=["ROUTE"], weightProp="w", costProp="c")
    rows = e.rows(call("SPpaths", "path, pathWeight, pathCost", **base))
    assert nodes(rows) == [[1, 2, 4]] and (rows[0].pathWeight, rows[0].pathCost) == (2.0, 10.0)
    rows = e.rows(call("SPpaths", "path, pathWeight, pathCost", maxCost=5, **base))
    assert nodes(rows) == [[1, 3, 4]] and (rows[0].pathWeight, rows[0].pathCost) == (4.0, 2.0)
    assert len(e.rows(call("SPpaths", pathCount=9, **base))) == 2


def test_parallel_relationships(spark):
    e = Engine(from_rows(spark, [], [rel("ROUTE", 1, 2, 5, weight=9), rel("ROUTE", 1, 2, 6, weight=1, cost=10)]))
    rows = e.rows(call("SPpaths", "path, pathWeight, pathCost", sourceNode=1, targetNode=2, relTypes=["ROUTE"], weightProp="weight", costProp="cost", pathCount=5))
    assert [(r.path.relationships[0].id, r.pathWeight, r.pathCost) for r in rows] == [(6, 1.0, 10.0), (5, 9.0, 0.0)]


def test_bare_edge_under_identified_ones(spark):
    e = Engine(from_rows(spark, [], [rel("R", 1, 2, None, w=7), rel("R", 1, 2, 3), rel("R", 2, 3, None, w=2)]))
    rows = e.rows(call("SPpaths", "path, pathWeight", sourceNode=1, targetNode=3, relTypes=["R"], weightProp="w", pathCount=5))
    assert [([x.id for x in r.path.relationships], r.pathWeight) for r in rows] == [([3, None], 9.0)]


ENTITIES = [{"id": i, "labels": ["Entity"], "name": n} for i, n in ((1, "alpha"), (2, "beta"), (3, "gamma"))] + [{"id": 4, "labels": ["Other"], "name": "alpha"}]
NAMES = ["alpha", "beta", "gamma"]


def test_multi_source(spark):
    r = [rel("RELATES", 1, 2, 1, k="ab"), rel("RELATES", 1, 2, 2, k="ab-2"), rel("RELATES", 2, 3, 3, k="bc"), rel("IGNORED", 4, 1, 4)]
    e = Engine(from_rows(spark, ENTITIES, r))
    rows = e.rows(call("MSpaths", sourceLabel="Entity", sourceProperty="name", sourceValues=NAMES, targetValues=NAMES, pairwise=True, relTypes=["RELATES"], relDirection="both", maxLen=2, pathCount=2))
    assert [(p[0], p[-1]) for p in nodes(rows)] == [(1, 2), (1, 2), (1, 3), (1, 3), (2, 3)]
    assert {r.path.relationships[0].id for r in rows[:2]} == {1, 2}
    rows = e.rows(call("MSpaths", sourceLabel="Entity", sourceProperty="name", sourceValues=["alpha"], relTypes=["RELATES"], maxLen=3))
    assert nodes(rows) == [[1, 2], [1, 2, 3]]


def test_fair_variants(spark):
    r = [rel("RELATES", 1, 2, i) for i in range(1, 5)] + [rel("RELATES", 2, 3, 9)]
    e = Engine(from_rows(spark, ENTITIES, r))
    base = dict(sourceLabel="Entity", sourceProperty="name", sourceValues=NAMES, targetValues=NAMES, pairwise=True, relTypes=["RELATES"], maxLen=1, relDirection="both", fairRelationshipVariants=True)
    rows = e.rows(call("MSpaths", resultLimit=3, **base))
    assert [(p[0], p[-1]) for p in nodes(rows)] == [(1, 2), (2, 3), (1, 2)]


@pytest.mark.parametrize("count", [0, 1, 3])
def test_many_targets_equal_single_pairs(spark, count):
    r = [rel("R", a, b) for a, b in ((1, 2), (1, 3), (1, 6), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5), (6, 5))]
    v = [{"id": i, "labels": ["V"], "name": f"n{i}"} for i in range(1, 7)]
    e = Engine(from_rows(spark, v, r))
    every = nodes(e.rows(call("SSpaths", sourceNode=1, relTypes=["R"], maxLen=4, pathCount=count)))
    multi = nodes(e.rows(call("MSpaths", sourceLabel="V", sourceProperty="name", sourceValues=["n1"], targetValues=[f"n{i}" for i in range(2, 7)], relTypes=["R"], maxLen=4, pathCount=count)))
    model = []
    for t in range(2, 7):
        model += model_paths([(a["src"], a["dst"]) for a in r], 1, t, 4, count)
    assert every == model and multi == model


def model_paths(edges, s, t, most, count):
    """Breadth-first simple paths in order of their edges; they may pass the target's siblings, not the target."""
    out, level = [], [[s]]
    for _ in range(most):
        level = [[*p, b] for p in level for a, b in sorted(edges) if a == p[-1] and b not in p and p[-1] != t]
        out += [p for p in level if p[-1] == t]
    if count == 0:
        out = [p for p in out if len(p) == len(out[0])] if out else []
        return sorted(out, key=lambda p: (len(p), p))
    return sorted(out[:count], key=lambda p: (len(p), p))


@pytest.mark.parametrize(
    "config",
    [
        {}, {"sourceNode": 1, "targetNode": 2}, {"sourceNode": 1, "relTypes": ["R"]}, {"sourceNode": 1, "targetNode": 2, "relTypes": []}, {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "maxLen": 17},
        {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "resultLimit": 0}, {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "relDirection": "up"}, {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "maxCost": -1},
        {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "pairwise": True}, {"sourceNode": 1, "targetNode": 2, "relTypes": ["R"], "what": 1}, {"sourceNode": -1, "targetNode": 2, "relTypes": ["R"]},
    ],
)
def test_refused_configurations(config):
    with pytest.raises(QueryError):
        spec(parse(call("SPpaths", **config)), 16)


def test_refused_multi_source_configurations():
    ok = dict(sourceLabel="E", sourceProperty="n", sourceValues=["a"], relTypes=["R"])
    spec(parse(call("MSpaths", **ok)), 16)
    for bad in (dict(pairwise=True), dict(sourceNode=1), dict(fairRelationshipVariants=True), dict(targetLabel="X"), dict(sourceValues=[""]), dict(targetValues=["a"], pairwise=True, fairRelationshipVariants=True, weightProp="w")):
        with pytest.raises(QueryError):
            spec(parse(call("MSpaths", **(ok | bad))), 16)
    with pytest.raises(LimitExceeded):
        spec(parse(call("MSpaths", maxLen=17, **ok)), 16)


def test_reach_and_bfs_against_a_model(spark):
    rnd = random.Random(7)
    edges = sorted({(rnd.randrange(12), rnd.randrange(12)) for _ in range(30)})
    adj = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(0,), (3,)], "origin long")
    for low, high in ((0, 2), (1, 3), (2, 2), (3, 5)):
        want = set()
        for o in (0, 3):
            level = {o}
            if low == 0:
                want.add((o, o))
            for h in range(1, high + 1):
                level = {b for a, b in edges if a in level}
                if h >= low:
                    want |= {(o, v) for v in level}
        assert {tuple(r) for r in reach(adj, starts, low, high).collect()} == want
    seen, level = {0, 3}, {0, 3}
    for _ in range(2):
        level = {b for a, b in edges if a in level} - seen
        seen |= level
    assert {r.v for r in bfs(adj, starts, 2).collect()} == seen - {0, 3}


def test_bfs_of_two_starts(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), *((42, x) for x in range(10, 17))]
    out = bfs(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,), (42,)], "id long"), 3)
    assert sorted(r.v for r in out.collect()) == [2, 3, 4, 5, 6, *range(10, 17)]


def test_adjacency_is_moved_once(spark, monkeypatch):
    from graphloom import storage

    edges = spark.range(3_000).selectExpr("id % 97 as src", "(id * 31 + 7) % 89 as dst").distinct()
    starts = spark.createDataFrame([(i,) for i in range(20)], "origin long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reach(edges, starts, 1, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("SelectedBucketsCount") >= 3
        want = {tuple(r) for r in reach(edges, starts, 2, 4).collect()}
        monkeypatch.setattr(storage, "_writable", lambda spark, folder: False)
        assert {tuple(r) for r in reach(edges, starts, 2, 4).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
