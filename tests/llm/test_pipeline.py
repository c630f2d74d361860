"""The pipeline: every stage on what the one before has kept."""

import pytest
from brute import brute_cut

import corpus_pipeline as P
from graphloom.llm import decontam, simhash, toxicity
from graphloom.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    steps = [docs]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, steps[-1], SF)
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType, name
        steps.append(written(out, "stage"))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 0.5 * len(ids[0])
    toxic = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert ids[1] == ids[0] - toxic
    found = simhash.near_duplicates(steps[1]).collect()
    assert ids[2] == {r.component_id for r in found}
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    after = {r.doc_id: r.text for r in steps[3].collect()}
    assert after == dict(brute_cut(before, 200, 50, 400)) and after != dict(before)
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    leaks = {r.doc_id for r in decontam.contaminated(steps[3], table(spark, SF, "benchmark")).collect()}
    assert ids[4] == ids[3] - leaks
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} == ids[4]
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "packing"]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "one two three"), (4, "x " * 50_000)]])
def test_odd_tables(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, None, None, None) for d, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, None, 0), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = P.run(spark, str(tmp_path)).collect()
    assert all(r.length >= 1 for r in pieces)
    if not rows:
        assert pieces == []
    else:
        assert sorted(r.doc_id for r in pieces if r.doc_id in (1, 3)) == [1, 3]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    other, copy = "quite another text of some more words than three", "one two three four five six seven"
    rows = [(1, copy), (2, copy), (2, other), (2, other), (3, "alone here in this row"), (None, copy), (None, copy)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, a string")
    got = sorted((str(r.doc_id), r.text) for r in P.drop_near_copies(spark, docs, SF).collect())
    assert got == sorted([("1", copy), ("2", other), ("3", "alone here in this row"), ("None", copy), ("None", copy)])
