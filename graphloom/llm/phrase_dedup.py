"""Repeated phrases: words in windows of `length` words that an earlier document has too.

Candidate regions come from recur. In each shard of them, windows that stand in two documents are
confirmed with the least doc_id that has them; runs of confirmed windows are the recurring passages.
They are compiled into an Aho-Corasick automaton over word numbers, a bounded number at a time, and
all regions of the shard are streamed through it to find every occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .recur import SPANS, Region, Words, batch, groups, keyed, merged, recurring_spans, windows_of


def occurrences(shard: list[list[Region]], length: int) -> Iterator[tuple[Region, list[tuple[int, int, int]]]]:
    """Regions of a shard that hold recurring passages, with (first window, last window, least doc_id)."""
    numbers: dict[bytes, int] = {}
    rows: list[tuple[Region, tuple, list[bytes], int, int]] = []
    for group in shard:
        for region in group:
            docs = [doc for _, _, doc, _ in region.places if doc is not None]
            if not docs:
                continue
            lo, hi = min(docs), max(docs)
            if len(group) == 1:  # one text of the region: it recurs as a whole or not at all
                if lo < hi:
                    yield region, [(0, region.text.count(b" ") + 1 - length, lo)]
                continue
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in region.text.split(b" ")], np.int32)
            raw = ids.tobytes()
            rows.append((region, tuple(ids.tolist()), [raw[4 * w : 4 * (w + length)] for w in range(len(ids) - length + 1)], lo, hi))
    # confirm: windows with the least and the largest doc_id that holds them
    low: dict[bytes, int] = {}
    high: dict[bytes, int] = {}
    for _, _, keys, lo, hi in rows:
        for key in keys:
            if low.get(key, lo) >= lo:
                low[key] = lo
            if high.get(key, hi) <= hi:
                high[key] = hi
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for _, ids, keys, _, _ in rows:
        w = 0
        while w < len(keys):
            z = w
            while z < len(keys) and low[keys[z]] < high[keys[z]]:
                z += 1
            if z > w:
                automaton.add_word(ids[w : z + length - 1], tuple(low[k] for k in keys[w:z]))
            w = z + 1
    if not len(automaton):
        return
    automaton.make_automaton()
    for region, ids, _, _, _ in rows:
        first: dict[int, int] = {}
        for end, lows in automaton.iter(ids):
            start = end + 2 - len(lows) - length
            first.update(zip(range(start, start + len(lows)), lows))
        spans: list[list[int]] = []
        for w in sorted(first):
            if spans and spans[-1][1] == w - 1 and spans[-1][2] == first[w]:
                spans[-1][1] = w
            else:
                spans.append([w, w, first[w]])
        if spans:
            yield region, [tuple(s) for s in spans]


def _kernel(length: int, shard_bytes: int = 2 << 20):
    def located(shard: list[list[Region]]) -> pa.RecordBatch:
        out = []
        for region, spans in occurrences(shard, length):
            for key, th, doc, starts in region.places:
                out.extend((key, th, lo, hi, first, starts) for lo, hi, first in spans if doc is not None and first < doc)
        return batch(out, SPANS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[list[Region]] = []
        held = 0
        for group in groups(batches):
            shard.append(group)
            held += sum(len(r.text) for r in group)
            if held > shard_bytes:
                yield located(shard)
                shard, held = [], 0
        if shard:
            yield located(shard)

    return kernel


def remove_phrases(docs: DataFrame, length: int = 13, hot: int = 20_000) -> DataFrame:
    """doc_id, n_words, spans (first and end word of each removed run) and kept text of every row.

    A word goes if a window of `length` words that covers it also starts in a row with a smaller
    doc_id. Words are parted by the six ASCII white-space characters and else unchanged; kept words
    are joined by one space. Null texts have no words. Rows of one doc_id never remove each other's
    words; rows with a null doc_id keep all theirs and take nothing from others. An empty table
    gives no rows. Grams in more than `hot` texts or
    8 * `hot` places are decided by counting their windows.
    """
    source = documents(docs)
    d = keyed(source, F.coalesce("doc_id", F.xxhash64("text")))
    spans = recurring_spans(source, d, (Words(length),), _kernel(length), (lambda n, lo, hi: lo < hi,), hot, by_document=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sizes, gone, kept = [], [], []
            for doc, text, th, found in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.split()
                mine = [(lo, hi) for lo, hi, first in windows_of(found, th) if doc is not None and first < doc]
                cuts = merged(mine, length)
                edges = [0, *(x for c in cuts for x in c), len(words)]
                kept.append(b" ".join(w for s, e in zip(edges[::2], edges[1::2]) for w in words[s:e]).decode())
                gone.append([{"start": s, "end": e} for s, e in cuts])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return d.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "th", "spans").mapInArrow(finish, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string")
