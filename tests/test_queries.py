"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

from graphloom.operators import paths
from graphloom.more_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want and got  # no query is compared on nothing


def test_fair_variants(spark):
    rows = QUERIES["fair_variants"](spark, SF).collect()
    assert [(r.nodes[0], r.nodes[-1]) for r in rows] == [(1, 2), (2, 3), (1, 2)]


def test_ss_paths_gives_all_rows_beyond_the_default_limit(spark, db, monkeypatch):
    monkeypatch.setattr(paths, "DEFAULT_LIMIT", 2)
    n = db.execute(f"SELECT count(*) FROM ({ORACLE_SQL['ss_paths']})").fetchone()[0]
    assert n > 2 and QUERIES["ss_paths"](spark, SF).count() == n


def test_parts_of_the_view_are_pruned(spark):
    plan = QUERIES["starts_with_prefix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    plan = QUERIES["count_star"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Distinct" not in plan
