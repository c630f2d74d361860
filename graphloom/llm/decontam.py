"""Benchmark decontamination by the q-gram lemma.

Every window of a benchmark item, beginning at each of its units, has an edit budget. Units are
characters and, in a second pass, words. Text within the budget of a window shares at least
(length - q + 1 - budget * q) of its q-grams, on diagonals that differ by the budget at most. Shared
q-grams are counted in overlapping diagonal bands; windows of an item that reach the bound in a band
are verified together by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship
from .recur import BASE, U, mix

Q = 10
WORDS, WORD_Q = 13, 3  # words of a window, and of a gram
NONE = 0xFFFFFFFF  # no unit of any item
BITS = 20
CHUNK = 1 << 19


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of each q units in a row, put together from runs of 1, 2, 4, 8 ... units."""
    h, m = mix((chars.astype(np.uint64) + U(1)) * U(BASE)), 1
    whole, done = None, 0
    while m <= q:
        if q & m:
            whole = h if whole is None else whole[: len(h) - done] * U(pow(BASE, m, 1 << 64)) + h[done:]
            done += m
        if 2 * m <= q:
            h = h[:-m] * U(pow(BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return mix(whole)


def budget(n: int, rate: float) -> int:
    """Edits allowed in n characters: the rate, but no more than leave a bound of one q-gram."""
    return max(0, min(int(n * rate), (n - Q) // Q))


def word_budget(n: int) -> int:
    """Words of n that may be replaced, put in or left out: one in six, none of fewer than eight."""
    return n // 6 if n >= 8 else 0


def windows(n: int, rate: float, size: int, step: int) -> list[tuple[int, int]]:
    """(length, budget) of the windows of an item of n characters: `size` of them, and all of a short item."""
    return [(m, budget(m, rate)) for m in sorted({min(n, size), n if n <= size + step else size})]


def word_windows(n: int) -> list[tuple[int, int]]:
    """(length, budget) of the windows of an item of n words; those without a budget are left to the characters."""
    m = min(n, WORDS)
    return [(m, word_budget(m))] if word_budget(m) else []


def window_distances(item: np.ndarray, starts: np.ndarray, length: int, text: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each window item[start : start + length] and any piece of text, and where that piece ends.

    Alignments stay on `width` diagonals (place in the text less place in the item) from `low`.
    """
    base = int(starts[0]) + low
    local = np.full(int(starts[-1] - starts[0]) + length + width, NONE, np.uint32)
    a, b = max(base, 0), min(base + len(local), len(text))
    if a < b:
        local[a - base : b - base] = text[a:b]
    bands = np.lib.stride_tricks.sliding_window_view(local, width)
    at = starts - starts[0]
    steps = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(starts), width), np.int32)
    for i in range(length):
        new = cost + (bands[at + i] != item[starts + i, None])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    end = cost.argmin(1)
    return cost[np.arange(len(starts)), end], np.clip(starts + length + low + end, 1, max(1, len(text)))


class Index:
    """q-gram postings of some items, each a row of units, under one or more kinds of window."""

    def __init__(self, items: list[tuple[int, np.ndarray, list[tuple[int, int]]]], q: int):
        self.q = q
        self.kinds: list[tuple[int, np.ndarray, int, int]] = []  # item, its units, length and budget of its windows
        keys, owners, places = [], [], []
        for item, units, lengths in items:
            for length, k in lengths:
                g = grams(units, q)
                keys.append(g)
                owners.append(np.full(len(g), len(self.kinds)))
                places.append(np.arange(len(g)))
                self.kinds.append((item, units, length, k))
        flat = np.concatenate(keys) if keys else np.array([], np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.owner = np.concatenate(owners)[order] if keys else np.array([], np.int64)
        self.place = np.concatenate(places)[order] if keys else np.array([], np.int64)
        self.known = np.zeros(1 << BITS, bool)
        self.known[(self.keys >> U(64 - BITS)).astype(np.int64)] = True
        length, k = (np.array([x[i] for x in self.kinds], np.int64) for i in (2, 3))
        self.span = length - q  # the last place of a gram less the first
        self.bound = length - q + 1 - k * q
        self.slack = k + 1
        # stretches of text that must hold so many hits, for windows of like size
        sizes: dict[int, tuple[int, int]] = {}
        for n, e, bound in zip(length.tolist(), k.tolist(), self.bound.tolist()):
            w, b = sizes.get(n // 32, (0, bound))
            sizes[n // 32] = (max(w, n + e), min(b, bound))
        self.sizes = list(sizes.values())

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Which hits lie in some stretch of text that holds as many hits as a window needs."""
        keep = np.zeros(len(at) + 1, np.int64)
        for width, bound in self.sizes:
            count = np.searchsorted(at, at + width) - np.arange(len(at))
            start = np.flatnonzero(count >= bound)
            np.add.at(keep, start, 1)
            np.add.at(keep, start + count[start], -1)
        return np.cumsum(keep[:-1]) > 0

    def find(self, units: np.ndarray, text_of: np.ndarray) -> dict[tuple[int, int], dict[tuple[int, int], tuple[int, int]]]:
        """(text, item) to the windows found, (length, place in item) to (edits, end in the text).

        units: texts one after another, with a gap of q units behind each; text_of: where each begins.
        Empty texts find nothing; of equal edits the place that ends first is given; repeated texts find the same.
        """
        found: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int]]] = {}
        if len(units) < self.q or not len(self.keys):
            return found
        h = grams(units, self.q)
        at = np.flatnonzero(self.known[(h >> U(64 - BITS)).astype(np.int64)])
        at = at[self.dense(at)]
        lo, hi = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], "right")
        real = hi > lo
        at, lo, hi = at[real], lo[real], hi[real]
        keep = self.dense(at)
        at, n, lo = at[keep], (hi - lo)[keep], lo[keep]
        if not len(at):
            return found
        posting = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        owner, place = self.owner[posting], self.place[posting]
        at = np.repeat(at, n)
        text = np.searchsorted(text_of, at, "right") - 1
        slack = self.slack[owner]
        band = (at - place) // slack
        # each hit counts in both bands over it, each place of an item once in a band
        rows = np.stack([np.tile(owner, 2), np.tile(text, 2), np.concatenate([band, band - 1]), np.tile(place, 2)])
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        owner, text, band, place = rows = rows[:, new]
        # a window needs `bound` hits: from each hit on, that many of the band must lie within its span
        last = np.arange(len(owner)) + self.bound[owner] - 1
        inside = np.minimum(last, len(owner) - 1)
        good = (last < len(owner)) & (rows[:3] == rows[:3, inside]).all(0) & (place[inside] - place <= self.span[owner])
        first = np.maximum(place[inside] - self.span[owner], 0)[good]
        owner, text, band, place = rows[:, good]
        if not len(owner):
            return found
        groups = np.flatnonzero(np.r_[True, (np.diff(rows[:3, good]) != 0).any(0)])
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(owner)]):
            item, whole, length, k = self.kinds[owner[a]]
            t = int(text[a])
            start = int(text_of[t])
            limit = (int(text_of[t + 1]) if t + 1 < len(text_of) else len(units)) - self.q
            mark = np.zeros(len(whole) - length + 2, np.int64)
            np.add.at(mark, first[a:b], 1)
            np.add.at(mark, np.minimum(place[a:b], len(whole) - length) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if not len(starts):
                continue
            # the band's diagonals: 2 * (k + 1) of them, and k on both sides
            edits, end = window_distances(whole, starts, length, units[start:limit], int(band[a]) * (k + 1) - k - start, 4 * k + 2)
            for i in np.flatnonzero(edits <= k).tolist():
                spans = found.setdefault((t, item), {})
                key = (length, int(starts[i]))
                spans[key] = min((int(edits[i]), int(end[i])), spans.get(key, (k + 1, 0)))
        return found


class Benchmark:
    """Indexes of the characters and of the words of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, size: int, step: int):
        self.short: list[tuple[int, str]] = []  # too short for a q-gram: looked up as they are
        self.vocabulary: dict[str, int] = {}
        by_char, by_word = [], []
        for item, text in items:
            norm = normalised(text)
            if len(norm) < Q:
                if norm:
                    self.short.append((item, norm))
                continue
            by_char.append((item, codes(norm), windows(len(norm), rate, size, step)))
            words = norm.split(" ")
            if lengths := word_windows(len(words)):
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                by_word.append((item, np.array(ids, np.uint32), lengths))
        self.chars, self.words = Index(by_char, Q), Index(by_word, WORD_Q)

    def find(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(text, item) to windows found, first and end character in the text, least edits in characters or words."""
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        starts = np.cumsum([0, *(len(t) + Q for t in texts)])[:-1]
        gap = "\0" * Q
        for key, spans in self.chars.find(codes(gap.join(texts) + gap), starts).items():
            found[key] = [(max(0, end - length), end, edits) for (length, _), (edits, end) in spans.items()]
        split = [t.split(" ") for t in texts]
        starts = np.cumsum([0, *(len(w) + WORD_Q for w in split)])
        units = np.zeros(starts[-1], np.uint32)
        for a, w in zip(starts.tolist(), split):
            units[a : a + len(w)] = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint32, len(w))
        for (text, item), spans in self.words.find(units, starts[:-1]).items():
            ends = np.cumsum([len(w) + 1 for w in split[text]]) - 1
            for (length, _), (edits, end) in spans.items():
                first = max(0, end - length)
                found.setdefault((text, item), []).append((int(ends[first] - len(split[text][first])), int(ends[end - 1]), edits))
        return {key: (len(s), min(x[0] for x in s), max(x[1] for x in s), min(x[2] for x in s)) for key, s in found.items()}


MATCHES = "doc_id long, item_id long, n_segments int, first_char long, end_char long, edits int"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, size: int = 80, step: int = 40, shard_chars: int = 4_000_000
) -> DataFrame:
    """One row per row of docs and item of which it holds a passage.

    A passage, after lower-casing and turning white space into single spaces: text within rate *
    length edits of any `size` characters in a row of the item (of the whole item if that has fewer,
    or, as well, if it has up to size + step); or text that differs from any 13 words in a row of
    the item (from the whole item if that has 8 to 12) by at most one word in six, replaced, put in
    or left out. n_segments: windows of the item found; first_char, end_char: where in the
    normalised text (the start is exact but for edits); edits: of the best window, in its
    characters or words. Items shorter than 10 characters are found as they stand. Null or empty
    items and texts match nothing.
    Items are read in shards of at most shard_chars characters; each shard is one reading of docs.
    """
    ship(docs.sparkSession)
    d = documents(docs)
    out = None
    for items in _shards(benchmark, shard_chars):
        part = _scan(d, items, rate, size, step)
        out = part if out is None else out.unionAll(part)
    return out


def _texts(texts: list[str | None], index: Benchmark) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(number of the text, item_id, windows, first and end character, edits) of each match."""
    at = 0
    while at < len(texts):
        group, held, total = at, [], 0
        while at < len(texts) and (at == group or total < CHUNK):
            t = normalised(texts[at] or "")
            for item, short in index.short:
                if (where := t.find(short)) >= 0:
                    yield at, item, 1, where, where + len(short), 0
            held.append(t)
            total += len(t) + Q
            at += 1
        for (text, item), match in index.find(held).items():
            yield group + text, item, *match


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float, size: int, step: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(items)  # at most shard_chars characters

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Benchmark(shipped.value, rate, size, step)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            ids = b.column(0)
            out = [(ids[i].as_py(), *rest) for i, *rest in _texts(b.column(1).to_pylist(), index)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in MATCHES.split(", ")])

    return docs.mapInArrow(work, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, size: int = 80, step: int = 40, shard_chars: int = 4_000_000) -> DataFrame:
    """docs, all columns as they are, without the rows that hold a passage of an item (see contaminated).

    With more than one shard of items, texts that hold one are named by a 64-bit hash, and rows with
    such a text left out by a join: no task ever holds two indexes.
    """
    ship(docs.sparkSession)
    shards = list(_shards(benchmark, shard_chars))
    if len(shards) == 1:
        shipped = docs.sparkSession.sparkContext.broadcast(shards[0])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shipped.value, rate, size, step)
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                keep = np.ones(len(texts), bool)
                for i, *_ in _texts(texts, index):
                    keep[i] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(work, docs.schema)
    name = F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(name.alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = reduce(lambda a, b: a.unionAll(b), (_scan(texts, items, rate, size, step) for items in shards)).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, name == bad["bad"], "left_anti")


def _shards(benchmark: DataFrame, shard_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items with text, at most about shard_chars characters at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    for shard in range(shards):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        yield [(r["item_id"], r["text"]) for r in rows]
