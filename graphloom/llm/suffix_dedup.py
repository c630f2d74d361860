"""Exact substring removal: bytes in strings of `length` bytes that occur anywhere else.

The regions around a recurring gram (see recur) are sorted as suffixes by deep-shallow sorting:
multikey quicksort to a shallow depth, then blind tries for the groups that agree so far. Sorted
from the anchor to the right, and reversed from the anchor to the left, the common prefixes of
neighbours tell how far any two regions agree on both sides, and so which windows they share.
Passages of so many words, which may have fewer bytes, are looked for in the same run; they are counted, not removed.

remove_repeats() takes out every place of a repeated string; without_repeats(), for corpora, leaves
the one in the earliest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .recur import SPANS, Bytes, Region, Words, batch, groups, keyed, merged, recurring_spans, windows_of

SHALLOW, STEP = 32, 8
WHITE = b" \t\n\x0b\x0c\r"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by looking at branching bytes only, and at one whole string for each that comes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None  # a leaf is a list of equal strings' numbers, a node is (depth, children by byte)

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            children = node[1]
            node = children.get(self._byte(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, key = node, self._byte(s, node[0])
            node = parent[1][key]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(s, depth)] = [i]
            return
        new = (depth, {self._byte(other, depth): node, self._byte(s, depth): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][key] = new

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            elif node is not None:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The numbers of the strings in the order of the strings."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) == 1:
            out.extend(part)
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in part:
                trie.add(i)
            out.extend(trie.order())
        else:
            pivot = strings[part[len(part) // 2]][depth : depth + STEP]
            less, same, more = [], [], []
            for i in part:
                key = strings[i][depth : depth + STEP]
                (same if key == pivot else less if key < pivot else more).append(i)
            if more:
                todo.append((more, depth))
            if same:
                todo.append((same, depth + STEP if len(pivot) == STEP else SHALLOW))
            if less:
                todo.append((less, depth))
    return out


def sorted_with_prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string, and what each string in order shares with the one before it (0 for the first)."""
    order = deep_shallow(strings)
    shared = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        shared[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, shared


NO_DOC = (1 << 63) - 1  # behind all documents


def shared_windows(regions: list[tuple[bytes, int, int, int]], length: int, firsts: bool = False) -> list[list[tuple[int, int, int]]]:
    """For each distinct region (bytes, anchor, how often, least document) the ranges of its windows that recur.

    With firsts, each range goes with the least document that has its windows, else with NO_DOC.
    """
    windows = [len(r) - length + 1 for r, *_ in regions]
    if len(regions) == 1:
        return [[(0, windows[0] - 1, regions[0][3])] if regions[0][2] > 1 else []]
    right, shared_r = sorted_with_prefixes([r[at:] for r, at, *_ in regions])
    left, shared_l = sorted_with_prefixes([r[:at][::-1] for r, at, *_ in regions])
    # least document of each window that recurs, -1 - NO_DOC for those that do not
    alone = -1 - NO_DOC
    marks = [np.full(w, doc if n > 1 else alone) for w, (_, _, n, doc) in zip(windows, regions)]
    if len(regions) <= 24:
        r_at, l_at = right.tolist(), left.tolist()
        r_in, l_in = shared_r.tolist(), shared_l.tolist()
        for i, (_, at, n, own) in enumerate(regions):
            if n > 1 and not firsts:
                continue
            for j, (*_, other) in enumerate(regions):
                if j != i:
                    x, y = sorted((r_at[i], r_at[j]))
                    r = min(r_in[x + 1 : y + 1])
                    x, y = sorted((l_at[i], l_at[j]))
                    lo, hi = max(0, at - min(l_in[x + 1 : y + 1])), min(windows[i] - 1, at - length + r)
                    if lo <= hi:
                        mark = marks[i][lo : hi + 1]
                        mark[mark == alone] = own
                        np.minimum(mark, other, out=mark)
    else:
        # many regions: for each distance d from window start to anchor, equal windows are equal classes
        ats = np.array([at for _, at, *_ in regions])
        docs = np.array([doc for *_, doc in regions])
        last = np.array(windows) - 1
        for d in range(int(max(0, (ats - last).min())), int(ats.max()) + 1):
            has = np.flatnonzero((ats - d >= 0) & (ats - d <= last))
            if len(has) < 2:
                continue
            r = np.cumsum(shared_r < length - d)[right[has]]
            l = np.cumsum(shared_l < d)[left[has]]  # noqa: E741
            both = r * (len(regions) + 1) + l
            _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
            least = np.full(len(counts), NO_DOC)
            np.minimum.at(least, inverse, docs[has])
            again = counts[inverse] > 1
            for i, first in zip(has[again].tolist(), least[inverse[again]].tolist()):
                marks[i][ats[i] - d] = first
    out: list[list[tuple[int, int, int]]] = []
    for mark in marks:
        if not firsts:
            mark = np.where(mark == alone, alone, NO_DOC)
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        out.append([(lo, hi - 1, int(mark[lo])) for lo, hi in zip(cuts, cuts[1:]) if mark[lo] != alone])
    return out


def shared_passages(group: list[Region], words: int) -> list[list[tuple[int, int, int]]]:
    """For each distinct region of words the ranges of its windows that stand in documents of two doc_ids."""
    docs = [[doc for _, _, doc, _ in r.places if doc is not None] for r in group]
    if len({doc for ids in docs for doc in ids}) < 2:
        return [[] for _ in group]
    if len(group) == 1:  # it recurs as a whole
        return [[(0, group[0].text.count(b" ") + 1 - words, NO_DOC)]]
    low: dict[bytes, int] = {}
    high: dict[bytes, int] = {}
    numbers: dict[bytes, int] = {}
    windows = []
    for region, ids in zip(group, docs):
        raw = np.array([numbers.setdefault(w, len(numbers)) for w in region.text.split(b" ")], np.int32).tobytes()
        windows.append([raw[i : i + 4 * words] for i in range(0, len(raw) - 4 * words + 1, 4)])
        if ids:
            lo, hi = min(ids), max(ids)
            for w in windows[-1]:
                low[w], high[w] = min(low.get(w, lo), lo), max(high.get(w, hi), hi)
    out = []
    for mine in windows:
        again = np.array([False, *(w in low and low[w] < high[w] for w in mine), False])
        edges = np.flatnonzero(again[1:] != again[:-1]).tolist()
        out.append([(lo, end - 1, NO_DOC) for lo, end in zip(edges[::2], edges[1::2])])
    return out


def _kernel(length: int, firsts: bool, words: int = 0):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches):
            least = [min((NO_DOC if doc is None else doc for _, _, doc, _ in r.places), default=NO_DOC) for r in group]
            if words and group[0].route & 1:
                found = shared_passages(group, words)
            else:
                found = shared_windows([(r.text, r.at, r.n, doc) for r, doc in zip(group, least)], length, firsts)
            for region, ranges in zip(group, found):
                for lo, hi, first in ranges:
                    out.extend((key, th, lo, hi, None if first == NO_DOC else first, starts) for key, th, _, starts in region.places)
            if len(out) > 20_000:
                yield batch(out, SPANS)
                out = []
        if out:
            yield batch(out, SPANS)

    return kernel


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = 20_000, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each removed run, in bytes) and kept bytes of every row.

    A byte goes if some string of `length` bytes that covers it also starts anywhere else, in another
    row or in the same one; overlapping occurrences count, strings never cross rows. Null texts count
    as empty; repeated rows are occurrences of their own; an empty table gives no rows. Grams in
    more than `hot` texts or 8 * `hot` places are decided by counting their windows instead of sorting them.

    With `words`, n_passage_words more: how many words of the row are covered by passages of `words`
    words that stand in documents of two doc_ids or more. It says what strings of `length` bytes are
    too long to see, and removes nothing. Words are parted by the six ASCII white-space characters
    and else unchanged; rows without a doc_id are no document that a passage stands in.
    """
    source = documents(docs)

    def cuts(text: bytes, doc: int | None, found: list[tuple]) -> list[tuple[int, int]]:
        return merged([(lo, hi) for lo, hi, _ in found], length)

    return _cut(source, source, length, hot, cuts, words=words).select("doc_id", "n_bytes", "spans", "kept", *(["n_passage_words"] if words else []))


def whole_words(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The range without words that it holds in part; as it is if it has no white space."""
    gaps = [i for i in range(start, end) if text[i] in WHITE]
    if not gaps:
        return start, end
    inside = lambda i: 0 < i < len(text) and text[i - 1] not in WHITE and text[i] not in WHITE
    a, z = gaps[0] if inside(start) else start, gaps[-1] + 1 if inside(end) else end
    return (a, z) if a < z else (start, end)


def without_repeats(docs: DataFrame, length: int = 200, words: int = 50, whole: int = 400, hot: int = 20_000) -> DataFrame:
    """docs, all columns, with repeated passages taken out of text but for their first document; rows that lose their whole text go.

    A run of bytes covered by strings of `length` bytes that also start in a row with a smaller doc_id
    is a passage, and goes, if it has more than `words` words or at least `whole` bytes: so passages of
    over 50 words are found that are shorter than 400 bytes, and short common lines stay. Words that
    a run holds in part stay, if it has white space; at a cut through a character, what is left of
    the character goes too. Between what is left a space is put if none is there. Rows with a null
    doc_id come behind all others; rows of one doc_id take nothing from each other. n_chars, if
    there, follows. Null texts count as empty; an empty table stays one.
    """

    def cuts(text: bytes, doc: int | None, found: list[tuple]) -> list[tuple[int, int]]:
        earlier = [(lo, hi) for lo, hi, first in found if first is not None and (doc is None or first < doc)]
        runs = ((s, e) for s, e in merged(earlier, length) if e - s >= whole or len(text[s:e].split()) > words)
        return [whole_words(text, s, e) for s, e in runs]

    cut = _cut(documents(docs), docs, length, hot, cuts, as_text=True).withColumnRenamed("kept", "text")
    cut = cut.filter("n_bytes = 0 or length(text) > 0")
    other = {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text", "n_chars")}
    other |= {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return cut.select(*[other[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _joined(parts: list[bytes]) -> str:
    out = ""
    for part in (p.decode(errors="ignore") for p in parts):
        out += (" " if out and part and not out[-1].isspace() and not part[0].isspace() else "") + part
    return out


def _cut(source: DataFrame, docs: DataFrame, length: int, hot: int, cuts: Callable, as_text: bool = False, words: int = 0) -> DataFrame:
    """docs with n_bytes, spans and kept bytes, or as_text the whole characters among them; with words n_passage_words too.

    cuts(text, doc_id, ranges of recurring windows) gives the ranges that go; without as_text nothing
    asks for first documents, so they are not looked for.
    """
    d = keyed(docs, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rest = ["rest"] if "rest" in d.columns else []
    kinds, recurs = (Bytes(length),), (lambda n, lo, hi: n > 1,)
    if words:
        kinds, recurs = (*kinds, Words(words)), (*recurs, lambda n, lo, hi: lo < hi)
    spans = recurring_spans(source, d, kinds, _kernel(length, as_text, words), recurs, hot, by_document=False)
    found = d.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "th", "spans", *rest)
    more = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    more += [T.StructField("n_passage_words", T.LongType())] if words else []
    schema = T.StructType([*(d.schema[c] for c in ("doc_id", *rest)), *more])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sizes, gone, kept, passages = [], [], [], []
            for doc, text, th, found in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), b.column(3).to_pylist()):
                out = cuts(text, doc, list(windows_of(found, th)))
                edges = [0, *(x for c in out for x in c), len(text)]
                parts = [text[s:e] for s, e in zip(edges[::2], edges[1::2])]
                kept.append(_joined(parts) if as_text else b"".join(parts))
                gone.append([{"start": s, "end": e} for s, e in out])
                sizes.append(len(text))
                if words:
                    passages.append(sum(e - s for s, e in merged([(lo, hi) for lo, hi, _ in windows_of(found, ~th)], words)))
            columns = [b.column(0), *b.columns[4:], pa.array(sizes, pa.int64()), pa.array(gone, span), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(passages, pa.int64())] if words else [])], schema.names)

    return found.mapInArrow(finish, schema)
