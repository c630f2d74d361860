"""Toxicity by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text.

A pair of zstandard dictionaries is trained on windows of ordinary and of toxic texts. A window's
saving is its length under the ordinary dictionary less that under both, so that ordinary words cost
the same on both sides and what is saved is what toxic text explains. The toxic dictionary is trained
on those parts of toxic texts that tell them from ordinary ones, found by compression too, in one of
two ways: windows that a sample of other toxic texts shortens more than a sample of ordinary texts, or
runs of bytes that ordinary texts have no copy of. Texts that no dictionary has seen calibrate
thresholds: for each saving the share of ordinary windows that reach it, and the score at which the
windows of a text are called toxic. They also say which of the two ways fits the labels better.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, ship
from .recur import U, mix

WINDOW, STEP = 80, 64  # bytes of a scored window, and between windows
MOST = 12  # savings above count as this
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    both: bytes
    rates: tuple  # of ordinary windows, those that save 0, 1, 2 ... bytes or more
    weights: tuple  # of the surprise and the mean saving, and a constant first; empty: every score is `prior`
    prior: float


def normalised(text: str) -> bytes:
    return (" " + " ".join(_WORD.findall(text.lower())) + " ").encode()


def windows(norm: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [norm[i : i + size] for i in range(0, max(1, len(norm)), step)]


def lengths(content: bytes):
    """A function from bytes to how many bytes they take under a dictionary, without any frame around them."""
    params = zstandard.ZstdCompressionParameters.from_level(
        6, window_log=20, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda w: len(compress(w))


class Savings:
    """Window savings of texts under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, both: bytes):
        self.plain, self.both = lengths(ordinary), lengths(both)

    def __call__(self, norm: bytes) -> np.ndarray:
        """How many windows save 0, 1, 2 ... bytes or more."""
        saved = np.array([self.plain(w) - self.both(w) for w in windows(norm)])
        at_least = np.bincount(np.clip(saved, 0, MOST), minlength=MOST + 1)[::-1].cumsum()[::-1]
        return np.append(at_least, saved.sum())


def evidence(savings: np.ndarray, rates: tuple) -> list[float]:
    """How surprising the text's windows are at the threshold where they are most so, and their mean saving.

    At a threshold, k of m windows against the m * rate that ordinary text has: the logarithm of a
    Poisson tail.
    """
    m = savings[0]
    surprise = 0.0
    for k, rate in zip(savings[1:-1], rates[1:]):
        usual = m * rate
        if k > usual:
            surprise = max(surprise, k * math.log(k / usual) - (k - usual))
    return [math.sqrt(surprise), savings[-1] / math.sqrt(m)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.savings = Savings(model.ordinary, model.both) if model.weights else None

    def score(self, text: str) -> float:
        m = self.model
        if not m.weights:
            return m.prior
        x = evidence(self.savings(normalised(text)), m.rates)
        z = m.weights[0] + sum(w * v for w, v in zip(m.weights[1:], x))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _trained(size: int, samples: list[bytes], k: int = 16) -> bytes:
    """A trained dictionary; for too few samples the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _content(texts: list[bytes], size: int) -> bytes:
    """Windows of the texts, taken evenly, as many as make `size` bytes."""
    every = [w for t in texts for w in windows(t, 256, 256)]
    return b"".join(every[:: max(1, sum(map(len, every)) // size)])[:size]


def by_windows(toxic: list[bytes], ordinary: list[bytes], size: int = 500_000, window: int = 40, share: float = 0.05, trained: int = 8192) -> tuple[bytes, bytes]:
    """(ordinary, both): the toxic dictionary is trained on those windows of toxic texts that other toxic texts shorten most against ordinary ones."""
    base = _content(ordinary, size)
    picked = []
    for mine, other in ((toxic[::2], toxic[1::2]), (toxic[1::2], toxic[::2])):
        content = _content(other, size)
        plain, like = lengths(base[: len(content)]), lengths(content)
        every = sorted({w for t in mine for w in windows(t, window, window // 2)})
        saved = np.array([plain(w) - like(w) for w in every])
        order = np.argsort(-saved, kind="stable")[: int(len(every) * share)]
        picked += [every[i] for i in order.tolist()]
    return base, _trained(trained, picked) + base


def by_novelty(toxic: list[bytes], ordinary: list[bytes], size: int = 65_536, gram: int = 7, trained: int = 2048) -> tuple[bytes, bytes]:
    """(ordinary, both): the toxic dictionary is trained on the runs of toxic texts whose strings of `gram` bytes no two ordinary texts have."""

    def grams(t: bytes) -> np.ndarray:
        x = np.frombuffer(t, np.uint8).astype(np.uint64)
        n = max(0, len(x) - gram + 1)  # a text shorter than a gram has none
        h = np.zeros(n, np.uint64)
        for i in range(gram):
            h = h * U(257) + x[i : i + n] + U(1)
        return mix(h)

    every, counts = np.unique(np.concatenate([np.unique(grams(t)) for t in ordinary]), return_counts=True)
    held = np.append(every[counts > 1], U(0xFFFFFFFFFFFFFFFF))
    runs = []
    for t in toxic:
        g = grams(t)
        fresh = np.flatnonzero(held[np.minimum(np.searchsorted(held, g), len(held) - 1)] != g)
        if len(fresh):
            cuts = np.flatnonzero(np.diff(fresh) > gram) + 1
            runs += [t[p[0] : p[-1] + gram] for p in np.split(fresh, cuts)]
    base = _trained(size, [w for t in ordinary for w in windows(t, 64, 64)])
    return base, base + _trained(trained, runs)


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[bytes, int]]:
    """Normalised texts without those that mostly repeat earlier ones: copies would make their chance words look like marks of a class."""
    seen: set[int] = set()
    out = []
    for text, y in rows:
        norm = normalised(text)
        words = norm.split()
        hashes = (zlib.crc32(b" ".join(words[i : i + 6])) for i in range(max(1, len(words) - 5)))
        few = {h for h in hashes if h % 8 == 0}
        if not few or len(few & seen) <= 0.3 * len(few):
            out.append((norm, y))
        seen |= few
    return out


def fit(rows: list[tuple[str, int]], totals: dict[int, int]) -> Model:
    """rows: (text, label 0 or 1); totals: labels of each class in all training rows, for the prior.

    Three quarters of the texts train the dictionaries, the rest calibrates.
    """
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    none = Model(b"", b"", (), (), prior)
    kept = _distinct(rows)
    cut = len(kept) * 3 // 4
    first, second = kept[:cut], kept[cut:]
    if any(len({y for _, y in part}) < 2 for part in (first, second)):
        return none
    toxic, ordinary = [t for t, y in first if y], [t for t, y in first if not y]
    y = np.array([y for _, y in second], float)
    # the sample holds the classes in other shares than the corpus
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) if 0 < prior < 1 else np.ones(len(y))
    best, least = none, math.inf
    for way in (by_windows, by_novelty):
        base, both = way(toxic, ordinary)
        if not both[len(base) :]:
            continue
        savings = Savings(base, both)
        s = np.array([savings(t) for t, _ in second])
        usual = s[y == 0, :-1].sum(0)
        rates = tuple(((usual + 1) / (usual[0] + 2)).tolist())
        weights, loss = _logistic(np.array([evidence(x, rates) for x in s]), y, weight)
        if loss < least:
            best, least = Model(base, both, rates, weights, prior), loss
    return best


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple, float]:
    """Constant and weights of a logistic model, and its loss."""
    scale = x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return (float(w[0]), *(w[1:] / scale).tolist()), loss


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, other_rows: int = 3500, max_bytes: int = 20_000) -> Model:
    """Fit on at most toxic_rows + other_rows labelled texts of at most max_bytes, those with the least hashes of their doc_id.

    Only rows outside of the held-out fold are read. The bounds are on the sample of the fit alone. A
    doc_id with both labels is left out; of several texts under one doc_id the least is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    texts = documents(docs).filter(F.octet_length("text") <= max_bytes)
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    totals = {r["y"]: r["count"] for r in there.groupBy("y").count().collect()}  # two rows
    least = lambda y, n: there.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    pick = least(1, toxic_rows).unionAll(least(0, other_rows))
    # at most toxic_rows + other_rows ids: broadcast
    rows = texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit([(r["text"], r["y"]) for r in rows], totals)


def score(docs: DataFrame, model: Model, score_column: str = "score", predicted_column: str = "predicted") -> DataFrame:
    """docs with two more columns behind all its own, whose names must be new; null texts count as empty."""
    if {score_column.lower(), predicted_column.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {score_column} or {predicted_column}")
    ship(docs.sparkSession)
    fields = [T.StructField(score_column, T.DoubleType()), T.StructField(predicted_column, T.IntegerType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t.as_py() or "") for t in b.column(b.schema.get_field_index("text"))]
            more = [pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, score_column, predicted_column])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *fields]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null and empty texts have the score of a text without savings. With labels of one class only, or
    none, every score is the share of toxic labels. Repeated rows are scored each; labels of unknown
    documents have no effect on the scores; an empty table gives no rows.
    """
    model = train(docs, labels)
    scored = score(documents(docs), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
