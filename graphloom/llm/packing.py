"""Best-fit packing with certified bin counts.

Documents become token pieces; pieces are dealt over partitions, each packed best-fit decreasing and
compared with a lower bound from dual-feasible functions. A partition whose bins match the bound is
certified and final. The others keep their full bins, give the pieces of their gapped bins into a
smaller pool, and are packed again with what other partitions gave; the last round is final.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship, written
from .tokens import Encoder

CAPACITY = 2048
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", part long, bin long, offset long, final boolean, bound long, bins long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: all but the first hold `capacity` tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Token pieces of every document; null text counts as empty, and repeated rows stay apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for doc, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = enc.ids(text.as_py() or "")
                ids.append(end)
                arr = np.array(ids, dtype="<u4")
                for k, (s, n) in enumerate(cut(len(arr), capacity)):
                    out.append((doc, copy, k, s, n, zlib.crc32(arr[s : s + n].tobytes())))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    d = documents(docs).select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return d.mapInArrow(work, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the classic dual-feasible functions over thresholds."""
    hist = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    best = -(-int((hist * sizes).sum()) // capacity)
    for k in np.unique(np.concatenate([[1], np.flatnonzero(hist[: capacity // 2 + 1])])):
        # sizes above capacity - k count as whole bins, sizes below k as nothing
        f = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, -(-int((hist * f).sum()) // capacity))
    for j in range(2, 30):
        # rounding down to multiples of 1/j, whole multiples kept
        t = sizes * (j + 1)
        f = np.where(t % capacity == 0, sizes * j, (t // capacity) * capacity)
        best = max(best, -(-int((hist * f).sum()) // (capacity * j)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each piece, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fills: list[int] = []
    room: dict[int, list[int]] = {}  # free space to open bins
    free: list[int] = []  # sorted keys of room
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(free, n)
        if at == len(free):
            b, left = len(fills), capacity
            fills.append(0)
        else:
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[at]
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left -= n
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _pack(capacity: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        done = last or len(fills) <= bound
        pdf = pdf.assign(bin=bins, offset=offsets, bound=bound, bins=len(fills))
        pdf["final"] = True if done else (fills[bins] == capacity)
        return pdf[[c.split()[0] for c in PLACED.split(", ")]]

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 50_000, shrink: int = 8) -> DataFrame:
    """Place every piece: sequence_id and offset, gapless from 0 in each sequence.

    per_partition bounds the pieces of a task (on average: they are dealt by hash). Rounds: gapped
    bins of uncertified partitions are pooled, about `shrink` partitions' worth at a time, more where
    they need no more room, until one partition is left, all are certified, or there are no fewer.
    """
    spark = pieces.sparkSession
    count = pieces.count()
    parts, base, done = max(1, -(-count // per_partition)), 0, []
    pool, last = pieces, parts == 1
    while True:
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(parts)))
        placed = dealt.groupBy("part").applyInPandas(_pack(capacity, last), PLACED)
        placed = written(placed, "packed")
        done.append(placed.filter("final").withColumn("part", F.col("part") + base))
        base += parts
        if last:
            break
        pool = placed.filter("not final").select(*pieces.columns)
        left = pool.count()
        if not left:
            break
        fewer = max(1, -(-left // per_partition), parts // shrink)
        last = fewer == 1 or fewer >= parts
        parts = min(parts, fewer)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.withColumn("sequence_id", F.col("part") * (1 << 32) + F.col("bin"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts give one piece of the end id. Repeated rows are packed once each. An empty
    table gives no rows. Only texts over `capacity` tokens are cut.
    """
    ship(docs.sparkSession)
    pieces = written(pieces_of(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
