"""A corpus pipeline: toxic texts and near copies go, repeated passages are cut, benchmark leaks go, the rest is packed.

Each stage takes all that the one before has kept and returns the columns of documents, the last
one its pieces. Null texts count as empty; rows with a null doc_id are near copies of nothing, and
where passages are cut they come behind all other rows; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, packing, simhash, suffix_dedup, toxicity
from graphloom.llm.common import table, written
from graphloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    free = "_" * (1 + max(map(len, docs.columns)))  # no column has it
    scored = toxicity.score(docs, model, f"{free}score", f"{free}toxic")
    return scored.filter(F.col(f"{free}toxic") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents those of the smallest doc_id; of rows that repeat doc_id and text one.

    A row goes if its own text is linked to a document with a smaller doc_id: where several texts stand
    under one doc_id, each is judged by itself.
    """
    hashes = ["xxhash64(coalesce(cast(text as string), '')) as a", "xxhash64(1L, coalesce(cast(text as string), '')) as b"]
    found = written(simhash.near_duplicates(docs.select("doc_id", "text"), keep=hashes), "near")
    row = F.struct(F.col("doc_id").cast("long").alias("id"), *map(F.expr, hashes))
    gone = found.filter("component_id <> doc_id").select(F.struct(F.col("doc_id").alias("id"), "a", "b").alias("row")).distinct()
    kept = docs.join(gone, row == gone["row"], "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id", "a", "b").count().filter("count > 1").limit(1).count():
        name = "_" * (1 + max(map(len, docs.columns)))  # no column has it
        known = kept.filter("doc_id is not null").withColumn(name, row).dropDuplicates([name])
        kept = known.drop(name).unionAll(kept.filter("doc_id is null"))
    return kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, or of 400 bytes and more, that an earlier document has too.

    The first document keeps its passage, so that no text leaves the corpus altogether.
    """
    return suffix_dedup.without_repeats(docs, length=200, words=50, whole=400)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage but the first filter could be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
