"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that link differ in at most two bits, so in at most two of their eight bytes: at least
six positional bytes are shared. Postings are kept for pairs of the four byte couples (six lists of
four positional bytes each), since a list of one byte alone grows with the corpus. Pairs of a list
are tallied over all eight positions, kept from six shared bytes on, and verified by their bits.
Copies of a fingerprint are one entry. A list that near copies make long is not paired up: its
members meet at the fingerprints one bit away, where two meet exactly if they differ in two bits or
less, and are linked to the least of each meeting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, documents, ship, written

SEED = 42
LANES = np.uint64(0x0101010101010101)
COUPLES = [0xFFFF << (16 * i) for i in range(4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose shingle hashes stand one after another, `counts` of each text.

    Bits are added up in byte lanes, 255 hashes at a time, eight bits of every hash at once.
    """
    ends = np.cumsum(counts)
    fp = np.zeros(len(counts), np.uint64)
    live = np.flatnonzero(counts)
    if not len(live):
        return fp
    starts = (ends - counts)[live]
    chunks = -(-counts[live] // 255)
    first = np.cumsum(chunks) - chunks  # of each text's chunks
    within = np.arange(chunks.sum()) - np.repeat(first, chunks)
    cuts = np.repeat(starts, chunks) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = 2 * sums > counts[live][:, None]
        for byte in range(8):
            fp[live] |= on[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return fp


def shingle_hashes(text: str, k: int) -> list[int]:
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return []
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(k)))), repeat(SEED)))


def fingerprints(docs: DataFrame, shingle: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, expressions in `keep`): fp is the 64-bit fingerprint as a signed long; null texts count as empty."""
    ship(docs.sparkSession)
    d = documents(docs).selectExpr("doc_id", "text", *keep)
    schema = T.StructType([d.schema["doc_id"], T.StructField("fp", T.LongType()), *d.schema.fields[2:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < b.num_rows:  # a bounded number of hashes at once, but one text at least
                start, counts, chunks, held = at, [], [], 0
                while at < b.num_rows and held < 300_000:
                    h = np.array(shingle_hashes(texts[at].as_py() or "", shingle), np.uint64)
                    counts.append(len(h))
                    chunks.append(h)
                    held += len(h)
                    at += 1
                fp = fingerprints_of(np.concatenate(chunks), np.array(counts, np.int64))
                more = [c.slice(start, at - start) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), pa.array(fp.view(np.int64)), *more], schema.names)

    return d.mapInArrow(work, schema)


def links(reps: DataFrame, hot: int = 64) -> DataFrame:
    """(u, v): enough links between rep ids of reps(fp, rep) to connect all that differ in two bits or less.

    Lists of at most `hot` members give every link; longer ones a star for each meeting point. Without
    nulls; one row for each fp, of which rep is the least doc_id, so that no two are equal.
    """
    masks = [signed(COUPLES[i] | COUPLES[j]) for i, j in combinations(range(4), 2)]
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])
    listed = reps.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.c", "k.key")
    sizes = listed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = listed.join(sizes, ["c", "key"])

    shared = " + ".join(f"if(((a.fp ^ b.fp) & {signed(255 << (8 * p))}L) = 0, 1, 0)" for p in range(8))
    pairs = members.filter(F.col("n") <= hot).groupBy("c", "key").agg(F.array_sort(F.collect_list(F.struct("rep", "fp"))).alias("m"))
    pairs = pairs.select(
        F.explode(
            F.expr(
                f"flatten(transform(m, (a, i) -> transform(filter(slice(m, i + 2, size(m)), b -> {shared} >= 6"
                " and bit_count(a.fp ^ b.fp) <= 2), b -> struct(b.rep as u, a.rep as v))))"
            )
        ).alias("p")
    ).select("p.u", "p.v")

    crowd = members.filter(F.col("n") > hot).select("fp", "rep").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)])
    met = crowd.select("rep", F.explode(near).alias("at"))
    least = met.groupBy("at").agg(F.min("rep").alias("v"), F.count("*").alias("n")).filter("n > 1").select("at", "v")
    stars = met.join(least, "at").filter("rep <> v").select(F.col("rep").alias("u"), "v")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs, and the expressions in `keep` (of doc_id and text).

    component_id is the smallest doc_id reachable over links. A text without words has fingerprint
    zero and is linked like any other; null texts count as empty. Rows with a null doc_id keep their
    fingerprint, take part in no link and have a null component. Repeated rows get a row each. An
    empty table gives no rows.
    """
    fps = written(fingerprints(docs, shingle, keep), "fingerprints")
    reps = fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(reps))
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(F.col("fp").alias("cfp"), F.coalesce("root", "rep").alias("root"))
    return fps.join(classes, F.col("fp") == F.col("cfp"), "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"),
        *fps.columns[2:],
    )
