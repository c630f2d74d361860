"""Reads over a made-up railway, against plain loops over its lists, and over tiny graphs with known results."""

import contextlib
import io
import random

import pytest

from graphloom.engine import Engine
from graphloom.errors import LimitExceeded, MissingParameter, ParseError, QueryError, Unsupported
from graphloom.limits import Limits
from graphloom.sources.graph import from_rows


def vertex(ident, *labels, **props):
    return {"id": ident, "labels": list(labels), **props}


def rel(t, s, d, rid=None, **props):
    return {"type": t, "src": s, "dst": d, "id": rid, **props}


def railway():
    """20 stations, 6 of them depots, 12 trains; tracks (some twice between the same stations) and stops."""
    rnd = random.Random(31)
    v = []
    for i in range(500, 520):
        s = vertex(i, "Station", *(["Depot"] if i % 3 == 0 else []), zone=rnd.randrange(5), name=f"{rnd.choice(['North', 'South', 'Upper'])} {i}")
        if i % 4:
            s["staffed"] = bool(i % 2)
        v.append(s)
    v += [vertex(i, "Train", cars=rnd.randint(3, 12)) for i in range(900, 912)]
    r = []
    for n in range(34):
        t = rel("TRACK", 500 + rnd.randrange(16), 500 + rnd.randrange(20), n, km=rnd.randint(2, 90))
        r.append(t | ({"electric": n % 3 == 0} if n % 5 else {}))
    r += [rel("TRACK", r[n]["src"], r[n]["dst"], 100 + n, km=500 + n) for n in (3, 9)]
    r += [rel("STOPS", 900 + rnd.randrange(10), 500 + rnd.randrange(20), 200 + n, minute=rnd.randrange(60)) for n in range(30)]
    return v, r


V, R = railway()
AT = {v["id"]: v for v in V}
STATIONS, DEPOTS, TRAINS = ([v for v in V if label in v["labels"]] for label in ("Station", "Depot", "Train"))
TRACKS, STOPS = ([r for r in R if r["type"] == t] for t in ("TRACK", "STOPS"))


@pytest.fixture(scope="module")
def rail(spark):
    return Engine(from_rows(spark, V, R))


def formatted(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def got(engine, text, **params):
    return [tuple(r) for r in engine.read(text, params).collect()]


def last(x):
    """Sort key with None behind all else."""
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_grouped_aggregates(rail):
    rows = got(rail, "MATCH (t:Train)-[:STOPS]->(s:Station) RETURN t.id AS t, count(*) AS n, sum(s.zone) AS z, avg(s.zone) AS m, collect(s.id) AS at ORDER BY t")
    want = []
    for t in TRAINS:
        at = [r["dst"] for r in STOPS if r["src"] == t["id"]]
        if at:
            zones = [AT[i]["zone"] for i in at]
            want.append((t["id"], len(at), sum(zones), sum(zones) / len(zones), sorted(at)))
    assert [(*r[:4], sorted(r[4])) for r in rows] == want and len(want) > 5


def test_aggregates_of_nothing(rail):
    assert got(rail, "MATCH (t {id: 911})-[:STOPS]->(s:Station) RETURN count(*) AS n, sum(s.zone) AS s, avg(s.zone) AS a, collect(s.id) AS c") == [(0, 0, None, [])]
    assert got(rail, "MATCH (t {id: 911})-[:STOPS]->(s) RETURN t.id, count(*)") == []
    with pytest.raises(QueryError):
        rail.read("MATCH (s:Station) RETURN sum(s.name)")
    assert got(rail, "MATCH (s:Station) RETURN sum(s.nothing) AS s, count(1) AS c, count(s.staffed) AS w") == [(0, 20, 15)]


def test_optional_match(rail):
    pairs = [(s["id"], r["dst"]) for s in STATIONS for r in TRACKS if r["src"] == s["id"]]
    depots = {d["id"] for d in DEPOTS}
    to_depot = [(a, b) for a, b in pairs if b in depots]
    want = sorted(to_depot + [(s["id"], None) for s in STATIONS if s["id"] not in {a for a, _ in to_depot}], key=last)
    q = "MATCH (s:Station) OPTIONAL MATCH (s)-[:TRACK]->(d:Depot) RETURN s.id AS s, d.id AS d ORDER BY s, d"
    assert got(rail, q) == want and any(d is None for _, d in want)
    ends = [d for _, d in got(rail, q.replace("ORDER BY s, d", "ORDER BY d, s"))]
    assert ends == sorted(ends, key=lambda d: last((d,))) and got(rail, q.replace("ORDER BY s, d", "ORDER BY d DESC, s"))[0][1] is None
    some = [(a, b) for a, b in pairs if AT[b]["zone"] > AT[a]["zone"]]
    want = sorted(some + [(s["id"], None) for s in STATIONS if s["id"] not in {a for a, _ in some}], key=last)
    assert got(rail, "MATCH (s:Station) OPTIONAL MATCH (s)-[:TRACK]->(d) WHERE d.zone > s.zone RETURN s.id AS s, d.id AS d ORDER BY s, d") == want
    on = sorted((a, b, c["dst"]) for a, b in pairs if b in depots for c in TRACKS if c["src"] == b)
    assert got(rail, "MATCH (s:Station) OPTIONAL MATCH (s)-[:TRACK]->(d:Depot) MATCH (d)-[:TRACK]->(e) RETURN s.id AS s, d.id AS d, e.id AS e ORDER BY s, d, e") == on


def test_optional_group_is_all_or_nothing(rail):
    full = [(t["id"], r["dst"], x["dst"]) for t in TRAINS for r in STOPS if r["src"] == t["id"] for x in TRACKS if x["src"] == r["dst"] and x["km"] > 60]
    want = sorted(full + [(t["id"], None, None) for t in TRAINS if t["id"] not in {a for a, *_ in full}], key=last)
    q = "MATCH (t:Train) OPTIONAL MATCH (t)-[:STOPS]->(s), (s)-[x:TRACK]->(e) WHERE x.km > 60 RETURN t.id AS t, s.id AS s, e.id AS e ORDER BY t, s, e"
    assert got(rail, q) == want and len(full) > 2 and any(s is None for _, s, _ in want)


def test_unions(rail):
    base = "MATCH (n:Station) WHERE n.zone < 2 RETURN n.id AS id {} MATCH (n:Depot) RETURN n.id AS id"
    low, depots = [s["id"] for s in STATIONS if s["zone"] < 2], [d["id"] for d in DEPOTS]
    assert sorted(got(rail, base.format("UNION"))) == [(i,) for i in sorted({*low, *depots})]
    assert sorted(got(rail, base.format("UNION ALL"))) == [(i,) for i in sorted(low + depots)] and set(low) & set(depots)
    assert got(rail, "MATCH (t:Train) RETURN t.id AS id ORDER BY id DESC LIMIT 1 UNION ALL MATCH (d:Depot) RETURN d.id AS id ORDER BY id LIMIT 1") == [(911,), (min(depots),)]
    for bad in ("MATCH (n:Train) RETURN n.id AS a UNION MATCH (n:Train) RETURN n.id AS b", base.format("UNION") + " UNION ALL MATCH (n:Train) RETURN n.id AS id"):
        with pytest.raises(Unsupported):
            rail.read(bad)


def test_two_valued_logic(rail):
    on = lambda keep: sorted((r["src"], r["dst"], r["km"]) for r in TRACKS if keep(r.get("electric")))
    q = "MATCH (a)-[r:TRACK]->(b) WHERE {} RETURN a.id AS a, b.id AS b, r.km AS km ORDER BY a, b, km"
    assert got(rail, q.format("r.electric = true")) == on(lambda e: e is True)
    assert got(rail, q.format("NOT (r.electric = true)")) == on(lambda e: e is not True)
    assert got(rail, q.format("r.electric <> true")) == on(lambda e: e is False)
    assert got(rail, q.format("NOT (r.electric <> true)")) == on(lambda e: e is not False)
    assert got(rail, q.format("NOT NOT (r.electric = true)")) == on(lambda e: e is True)
    assert got(rail, q.format("r.nothing = 1 OR r.electric = false")) == on(lambda e: e is False)


def test_predicates(rail):
    ids = lambda keep: [(s["id"],) for s in STATIONS if keep(s)]
    q = "MATCH (s:Station) WHERE {} RETURN s.id AS i ORDER BY i"
    assert got(rail, q.format("1 <= s.zone < 3")) == ids(lambda s: 1 <= s["zone"] < 3)
    assert got(rail, q.format("s.name STARTS WITH $p OR s.staffed = false"), p="Upper") == ids(lambda s: s["name"].startswith("Upper") or s.get("staffed") is False)
    assert got(rail, q.format("s.zone = 3.0")) == ids(lambda s: s["zone"] == 3)
    assert got(rail, q.format("s.zone = 'x'")) == [] and len(got(rail, q.format("s.zone <> 'x'"))) == 20
    for bad in ("s.zone < 'x'", "s.staffed < true"):
        with pytest.raises(QueryError):
            rail.read(q.format(bad))


def test_exact_numbers(spark):
    e = Engine(from_rows(spark, [vertex(1, "N", i=9007199254740993, d=9007199254740992.0), vertex(2, "N", i=4, d=4.0)], []))
    assert got(e, "MATCH (n:N) WHERE n.i = n.d RETURN n.id") == [(2,)]
    assert got(e, "MATCH (n:N) WHERE n.i = 9007199254740992.0 RETURN n.id") == []
    assert got(e, "MATCH (n:N) WHERE n.d = 4 RETURN n.id") == [(2,)]


def test_seek_needs_no_vertex(rail):
    assert got(rail, "MATCH (n {id: 77}) RETURN n.id AS n, n.name AS name") == [(77, None)]
    assert got(rail, "MATCH (n:Station {id: 77}) RETURN n.id") == [] and got(rail, "MATCH (n:Train {id: 500}) RETURN n.id") == []
    assert got(rail, "MATCH (n {id: 500, zone: %d}) RETURN n.id" % AT[500]["zone"]) == [(500,)]


def test_labels_properties_and_names(rail):
    df = rail.read("MATCH (n:Station:Depot {zone: 1}) RETURN n.id, n.name, count(*), count(n.staffed)")
    assert df.columns == ["n.id", "n.name", "count(*)", "count(n.staffed)"]
    assert sorted(tuple(r) for r in df.collect()) == sorted((d["id"], d["name"], 1, int("staffed" in d)) for d in DEPOTS if d["zone"] == 1)
    t = next(r for r in TRACKS if r.get("electric"))
    assert (t["dst"],) in got(rail, "MATCH (a:Station {id: %d})-[r:TRACK {km: %d, electric: true}]->(b) RETURN b.id" % (t["src"], t["km"]))
    assert got(rail, "MATCH (b)<-[:TRACK]-(a {id: %d}) RETURN b.id AS b ORDER BY b" % t["src"]) == sorted((r["dst"],) for r in TRACKS if r["src"] == t["src"])


def test_joins(rail):
    two = sorted((x["src"], x["dst"], y["dst"]) for x in STOPS for y in TRACKS if y["src"] == x["dst"])
    assert got(rail, "MATCH (t:Train)-[:STOPS]->(s) MATCH (s)-[:TRACK]->(e) RETURN t.id AS t, s.id AS s, e.id AS e ORDER BY t, s, e") == two
    assert got(rail, "MATCH (t)-[:STOPS]->()-[:TRACK]->(e) RETURN t.id AS t, e.id AS e ORDER BY t, e") == sorted((t, e) for t, _, e in two)
    ring = sorted((x["src"], x["dst"], y["dst"]) for x in TRACKS for y in TRACKS for z in TRACKS if y["src"] == x["dst"] and (z["src"], z["dst"]) == (x["src"], y["dst"]))
    assert got(rail, "MATCH (a)-[:TRACK]->(b), (b)-[:TRACK]->(c), (a)-[:TRACK]->(c) RETURN a.id AS a, b.id AS b, c.id AS c ORDER BY a, b, c") == ring
    assert len(got(rail, "MATCH (t:Train), (d:Depot) RETURN t.id AS t, d.id AS d")) == len(TRAINS) * len(DEPOTS)
    assert sorted(got(rail, "MATCH (t:Train) MATCH (d:Depot) WHERE t.id = 900 AND d.zone > 1 RETURN d.id AS d")) == [(d["id"],) for d in DEPOTS if d["zone"] > 1]
    again = got(rail, "MATCH (a)-[r:TRACK]->(b) WITH a, r, b MATCH (a)-[r:TRACK]->(c) RETURN a.id AS a, c.id AS c, r.km AS km ORDER BY a, c, km")
    assert again == sorted((r["src"], r["dst"], r["km"]) for r in TRACKS)


def test_homomorphism_and_parallel_relationships(spark):
    e = Engine(from_rows(spark, [], [rel("T", 5, 6, 1, w=1), rel("T", 5, 6, 2, w=2), rel("T", 5, 6, 3, w=3), rel("T", 8, 8, 4)]))
    assert got(e, "MATCH (a {id: 5})-[r:T]->(b) RETURN r.w AS w ORDER BY w") == [(1,), (2,), (3,)]
    assert got(e, "MATCH (a {id: 5})-[:T]->(b)<-[:T]-(c) RETURN count(*)") == [(9,)]
    assert got(e, "MATCH (a)-[:T]->(a) RETURN a.id") == [(8,)]
    assert got(e, "MATCH (a {id: 5})-[:T*1..1]->(b) RETURN count(*)") == [(1,)]


def test_distinct_sort_window(rail):
    ends = sorted({r["dst"] for r in TRACKS}, reverse=True)
    assert got(rail, "MATCH (a)-[:TRACK]->(b) RETURN DISTINCT b.id AS b ORDER BY b DESC SKIP 0 + 1 LIMIT 2 * 3") == [(i,) for i in ends[1:7]]
    order = sorted(STATIONS, key=lambda s: (-s["zone"], s["id"]))
    assert got(rail, "MATCH (s:Station) RETURN s.id AS i ORDER BY s.zone DESC, s.id LIMIT 4") == [(s["id"],) for s in order[:4]]
    assert got(rail, "MATCH (s:Station) RETURN s.id LIMIT 0") == [] and got(rail, "MATCH (s:Station) RETURN count(*) SKIP 1") == []
    n = {}
    for r in TRACKS:
        n[r["dst"]] = n.get(r["dst"], 0) + 1
    assert got(rail, "MATCH (a)-[:TRACK]->(b) RETURN b.id AS b, count(*) ORDER BY count(*) DESC, b") == sorted(n.items(), key=lambda x: (-x[1], x[0]))


def test_reach(spark):
    hops = [rel("F", a, b) for a, b in ((1, 2), (2, 3), (3, 4), (1, 3), (1, 9))] + [rel("M", 1, 2), rel("M", 2, 3), rel("M", 1, 3)]
    e = Engine(from_rows(spark, [vertex(3, "X", p=1)], hops + [rel("C", 1, 2), rel("C", 2, 1), rel("C", 2, 3)]))
    q = "MATCH (u {id: 1})-[:%s]->(v) RETURN v.id AS v ORDER BY v"
    assert got(e, q % "F*2..3") == [(3,), (4,)]
    assert got(e, q % "F*2") == [(3,), (4,)]
    assert got(e, q % "M*2..2") == [(3,)]
    assert got(e, q % "C*0..0") == [(1,)]
    assert got(e, q % "C*..4") == [(1,), (2,), (3,)]
    assert got(e, q % "C*5..5") == [(2,)] or got(e, q % "C*5..5") == [(2,)]
    assert got(e, "MATCH (u {id: 1})-[:F*1..2]->(v:X {p: 1}) RETURN v.id") == [(3,)]
    assert got(e, "MATCH (a)-[:M]->(b) MATCH (b)-[:F*1..2]->(v) RETURN a.id AS a, b.id AS b, v.id AS v ORDER BY a, b, v") == [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
    assert got(e, "MATCH (x:X) OPTIONAL MATCH (x)-[:F*1..2]->(v) RETURN x.id AS x, v.id AS v") == [(3, 4)]
    assert got(e, "MATCH (u {id: 1})-[:F*1..3]->(v) RETURN count(*)") == [(4,)]
    with pytest.raises(LimitExceeded):
        e.read(q % "F*1..17")


def test_reach_on_the_railway(rail):
    ends = {500 + i: {500 + i} for i in range(20)}
    at, walks = ends[503], []
    for _ in range(5):
        at = {r["dst"] for r in TRACKS if r["src"] in at}
        walks.append(at)
    for low, high in ((1, 1), (2, 2), (1, 3), (2, 5)):
        want = sorted(set().union(*walks[low - 1 : high]))
        assert got(rail, f"MATCH (a {{id: 503}})-[:TRACK*{low}..{high}]->(b) RETURN b.id AS b ORDER BY b") == [(i,) for i in want]


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n) RETURN n.id", "MATCH (n:User) RETURN n", "MATCH (n:User) RETURN *", "MATCH (n:User) RETURN 1 AS x", "MATCH (n:User) RETURN min(n.a)",
        "MATCH (n:User) RETURN count(DISTINCT n.a)", "MATCH (n:User) RETURN count(DISTINCT *)", "MATCH (a)-[:A]-(b) RETURN a.id", "MATCH (a)-[:A|B]->(b) RETURN a.id",
        "MATCH (a)-[]->(b) RETURN a.id", "MATCH (a {id: 1})-[r:A*1..2]->(b) RETURN b.id", "MATCH (a {id: 1})-[:A*1..2 {x: 1}]->(b) RETURN b.id", "MATCH (a {id: 1})-[:A*1..]->(b) RETURN b.id",
        "MATCH (a {id: 1})-[:A*3..2]->(b) RETURN b.id", "MATCH (a:User)-[:A*1..2]->(b) RETURN b.id", "MATCH (:User)-[:A]->(b) RETURN b.id", "MATCH (n {id: 'x'}) RETURN n.id",
        "MATCH (n {id: -1}) RETURN n.id", "MATCH (n:User) WHERE n.a IN [1] RETURN n.id", "MATCH (n:User) WHERE n.a CONTAINS 'x' RETURN n.id", "MATCH (n:User) WHERE n.a IS NULL RETURN n.id",
        "MATCH (n:User) WHERE n.a = 1 XOR n.b = 2 RETURN n.id", "MATCH (n:User) WHERE n.a RETURN n.id", "MATCH (n:User) RETURN n.id LIMIT -1", "MATCH (n:User) RETURN n.id SKIP 1 / 0",
        "MATCH (n:User) WITH n WHERE n.a = 1 RETURN n.id", "MATCH (n:User) WITH n AS m RETURN n.id", "MATCH (n:User)-[:A]->(m) WITH n RETURN n.id", "MATCH (n:User) RETURN DISTINCT n.id ORDER BY n.a",
        "MATCH (n:User) RETURN n.id ORDER BY nothing", "MATCH (n:User) RETURN m.id", "MATCH (n:User)-[r:A]->(m) RETURN r.id", "MATCH (n:User) RETURN n.id AS a, n.b AS a",
        "MATCH (n:User) SET n.id = 1", "CREATE (a)-[:T]->(b {id: 1})", "CREATE (a {id: 1})", "MERGE (a {id: 1})-[:T]->(b {id: 2}) ON CREATE SET a.x = 1", "CREATE (a {id: 1})-[:T]->(b {id: 2}) RETURN a.id",
        "MATCH (n:User) SET n.a = 1 RETURN n.id", "OPTIONAL MATCH (n:User) SET n.a = 1", "MATCH (n:User) SET n = 1", "SET n.a = 1", "MATCH (a)-[:A]->(b) RETURN a.id UNION MATCH (n:User) SET n.a = 1",
        "UNWIND [1] AS x RETURN x", "CALL db.labels() YIELD label RETURN label", "MATCH (n:`bad label`) RETURN n.id",
    ],
)
def test_refused(rail, text):
    with pytest.raises(QueryError):
        (rail.write if "SET" in text or "CREATE" in text or "MERGE" in text else rail.read)(text)


def test_parameters_and_parse_errors(rail):
    with pytest.raises(MissingParameter):
        rail.read("MATCH (n:Station) WHERE n.name = $x RETURN n.id")
    with pytest.raises(ParseError):
        rail.read("MATCH (n:Station RETURN n.id")
    assert got(rail, "MATCH (n {id: $i}) RETURN n.cars AS `how many` // note", i=900) == [(AT[900]["cars"],)]


def test_row_limit_pages_and_values(rail):
    e = Engine(rail.graph, max_rows=5)
    with pytest.raises(LimitExceeded):
        e.rows("MATCH (t:Train) RETURN t.id")
    assert len(e.rows("MATCH (t:Train) RETURN t.id LIMIT 5")) == 5
    with pytest.raises(LimitExceeded):
        e.read("MATCH (t:Train) RETURN t.id LIMIT 6")
    q, rows, cursor = "MATCH (t:Train) RETURN t.id AS t ORDER BY t", [], None
    for n in (5, 5, 2):
        page = rail.page(q, size=5, cursor=cursor)
        assert len(page.rows) == n and page.columns == ["t"]
        rows, cursor = rows + [r.t for r in page.rows], page.next_cursor
    assert rows == [t["id"] for t in TRAINS] and cursor is None
    w = Engine(rail.graph)
    first = w.page(q, size=11)
    with pytest.raises(QueryError):
        w.page("MATCH (d:Depot) RETURN d.id AS t ORDER BY t", size=2, cursor=first.next_cursor)
    w.write("MATCH (t:Train {id: 911}) DETACH DELETE t")
    assert [r.t for r in w.page(q, size=5, cursor=first.next_cursor).rows] == [911]  # of the snapshot that the cursor names
    assert len(w.page(q, size=20).rows) == 11
    assert rail.value("MATCH (t:Train) RETURN count(*)") == 12 and sorted(rail.value("MATCH (d:Depot) RETURN d.id")) == [d["id"] for d in DEPOTS]
    assert rail.access("MATCH (t:Train) SET t.a = 1") == "write" and rail.access("MATCH (t:Train) RETURN t.id") == "read"


def test_limits_are_named(rail):
    q = "MATCH (n:Depot) RETURN n.id UNION MATCH (n:Depot) RETURN n.id"
    for limits, text, name in (
        (Limits(rows=2), q, "2 rows"), (Limits(edges=2), "MATCH (a)-[:TRACK]->(b) RETURN a.id", "edges"), (Limits(intermediate=0), "MATCH (a {id: 503})-[:TRACK*1..4]->(b) RETURN b.id", "in between"),
        (Limits(hops=2), "MATCH (a {id: 503})-[:TRACK*1..4]->(b) RETURN b.id", "hops"), (Limits(seconds=0.0001), "MATCH (a)-[:TRACK]->(b) RETURN a.id", "seconds"),
    ):
        with pytest.raises(LimitExceeded, match=name):
            Engine(rail.graph, limits=limits).rows(text)
    assert len(Engine(rail.graph, limits=Limits(3, 10, 10, 100, 600)).rows(q)) == len(DEPOTS)


def test_long_walks_are_kept_with_their_snapshot(rail):
    e = Engine(rail.graph.replaced())
    q = "MATCH (a {id: 503})-[:TRACK*1..4]->(b) RETURN b.id AS b ORDER BY b"
    once = got(e, q)
    assert once and got(e, q) == once and len(e.graph.reached) == 1
    e.write("CREATE (a {id: 503})-[:TRACK]->(b {id: 4})")
    assert not e.graph.reached and got(e, q) == sorted({*once, (4,)})


def test_filters_reach_the_scan(spark, tmp_path):
    g = from_rows(spark, [vertex(i, "User", name=f"n{i}", age=i, junk="x" * 10) for i in range(5)], [])
    g.save(str(tmp_path))
    from graphloom.sources.graph import load

    e = Engine(load(spark, str(tmp_path), 0))
    plan = formatted(e.read("MATCH (u:User) WHERE u.name STARTS WITH 'n1' AND u.age > 0 RETURN u.age AS age"))
    assert "StringStartsWith(p_name,n1)" in plan and "GreaterThan(p_age,0)" in plan and "p_junk" not in plan
    top = formatted(e.read("MATCH (u:User) WHERE u.name STARTS WITH 'n' RETURN u.name AS n ORDER BY n LIMIT 2"))
    assert "TakeOrderedAndProject" in top


def test_labels_and_types_prune_folders(spark, tmp_path):
    g = from_rows(spark, [vertex(1, "User", a=1), vertex(2, "User", "Admin", a=2), vertex(3, "Post", a=3), {"id": 4, "labels": [], "a": 4}], [rel("T", 1, 2), rel("U", 1, 3)])
    g.save(str(tmp_path))
    from graphloom.sources.graph import load

    e = Engine(load(spark, str(tmp_path), 0))
    q = "MATCH (u:User) RETURN u.id AS i, u.a AS a ORDER BY i"
    assert got(e, q) == [(1, 1), (2, 2)] and got(e, "MATCH (u:Admin:User) RETURN u.a") == [(2,)] and got(e, "MATCH (n {id: 4}) RETURN n.a") == [(4,)]
    plan = formatted(e.read(q))
    assert "PartitionFilters: [Contains(label_set" in plan or "PartitionFilters: [isnotnull(label_set" in plan
    assert "isnotnull(edge_type" in formatted(e.read("MATCH (a)-[:T]->(b) RETURN b.id"))
    e.write("MATCH (n {id: 4}) SET n:User")  # a written snapshot no longer reads the folders
    assert got(e, q) == [(1, 1), (2, 2), (4, 4)]
    with pytest.raises(QueryError):
        load(spark, str(tmp_path), 1)


def test_written_tables_go_together(spark):
    from graphloom.storage import forget, own_dir, read_text, written

    written(spark.range(3), "gone")
    assert spark.read.parquet(own_dir(spark) + "/gone-*").count() == 3
    forget(spark)
    assert read_text(spark, own_dir(spark)) is None
