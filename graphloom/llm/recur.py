"""Finding windows of `length` units (bytes or words) that recur, without comparing texts pairwise.

Each window has an anchor: the leftmost least gram hash in it. Equal windows have equal anchors, so
a window can recur only if its anchor's gram does. Texts are read once for the grams of their
anchors; texts with recurring grams are cut into regions (all windows of one anchor), equal regions
are counted once, and a kernel decides for the distinct regions of a gram which windows recur. Grams
so frequent that their regions should not meet in one task take another exact way: one row for each
window, counted by content.

Two kinds of windows, of bytes and of words, can be looked for at once: the last bit of a gram says
which it is of, and spans of the second kind go under the complement of the text's hash.

Texts are shuffled once, and so are the grams of each text: both uses of an exchange share it. Grams
that hold more than their share of all rows are found beforehand, by counters that miss none of
them, and their rows are dealt over several partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, ship

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LOW = U((1 << 24) - 1)
CHUNK = 1 << 20  # units or bytes looked at together


def _schema(**fields: str) -> T.StructType:
    """Columns as named; those ending in ! are never null (so that no filter on them splits an exchange)."""
    types = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(k, types[v.strip("!")], not v.endswith("!")) for k, v in fields.items()])


GRAMS = _schema(g="long!", key="long!", n="long!")
REGIONS = _schema(key="long!", th="long!", doc_id="long", route="long!", at="int!", starts="binary!", region="binary!")
SHARES = _schema(g="long", n="long!")
WINDOWS = _schema(key="long!", th="long!", doc_id="long", h1="long!", h2="long!", n="long!", starts="binary!")
SPANS = _schema(key="long!", th="long!", lo="int!", hi="int!", first="long", starts="binary!")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


@cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        out[0] = 1
        k = 1
        while k < n:
            step = U(pow(b, k, 1 << 64))
            m = min(k, n - k)
            out[k : k + m] = out[:m] * step
            k *= 2
    return up, down


def grams(units: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q units in a row; q is a power of two."""
    h, m = units, 1
    while m < q:
        h = h[:-m] * U(pow(BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return mix(h)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(blocks, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchored_runs(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, of texts that stand one after another in `units`.

    Returns text number, first and last window, anchor (all counted in their text) and gram hash.
    """
    counts = np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    if not total:
        e = np.array([], np.int64)
        return e, e, e, e, np.array([], np.uint64)
    g = grams(units, q)
    order = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
    least = slide_min(order, length - q + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    anchor = (least[window] & LOW).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    t = text[at]
    return t, window[at] - starts[t], window[last] - starts[t], anchor[at] - starts[t], g[anchor[at]]


class Bytes:
    """Units are the UTF-8 bytes of a text."""

    def __init__(self, length: int, q: int = 32):
        while q > length:
            q //= 2
        self.length, self.q = length, q

    def chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        return byte_codes()[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum(sizes) - sizes, sizes

    def pieces(self, text: bytes) -> Callable[[int, int], bytes]:
        """What stands from one unit up to another."""
        return lambda lo, hi: text[lo:hi]


class Words:
    """Units are words between white space, as they stand."""

    def __init__(self, length: int, q: int = 4):
        while q > length:
            q //= 2
        self.length, self.q = length, q

    def chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True))  # starts and ends of words in turn
        begin, end = edge[0::2], edge[1::2]
        up, down = powers(1 << max(20, int(len(raw)).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte_codes()[raw] * up[: len(raw)], out=sums[1:])
        words = mix((sums[end] - sums[begin]) * down[begin])
        offsets = np.cumsum(sizes) - sizes
        first = np.searchsorted(begin, offsets)
        return words, first, np.diff(np.append(first, len(begin)))

    def pieces(self, text: bytes) -> Callable[[int, int], bytes]:
        """The words from one up to another, with one space between them."""
        words = text.split()
        line = b" ".join(words)
        at = [0, *np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()]
        return lambda lo, hi: line[at[lo] : at[hi] - 1]


def _long_text(kind, text: bytes):
    """Runs of one long text, in pieces that overlap by less than a window; a run may be cut in two."""
    units, _, _ = kind.chunk([text])
    parts = []
    step = (1 << 22) - kind.length
    for s in range(0, max(1, len(units) - kind.length + 1), step):
        piece = units[s : s + step + kind.length - 1]
        _, a, b, p, g = anchored_runs(piece, np.array([0]), np.array([len(piece)]), kind.length, kind.q)
        parts.append((a + s, b + s, p + s, g))
    return tuple(np.concatenate(c) for c in zip(*parts))


def runs_of(kind, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first windows, last windows, anchors, grams) of each text that has windows."""
    at = 0
    while at < len(texts):
        size, group = 0, []
        while at < len(texts) and (not group or size + len(texts[at] or b"") <= CHUNK):
            group.append(at)
            size += len(texts[at] or b"")
            at += 1
        if size > CHUNK:
            a, b, p, g = _long_text(kind, texts[group[0]])
            if len(a):
                yield group[0], a, b, p, g
            continue
        t, a, b, p, g = anchored_runs(*kind.chunk([texts[i] or b"" for i in group]), kind.length, kind.q)
        cuts = np.flatnonzero(np.diff(t)) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(t))):
            if j > i:
                yield group[t[i]], a[i:j], b[i:j], p[i:j], g[i:j]


def runs_of_kinds(kinds: tuple, texts: list[bytes | None]) -> Iterator[tuple]:
    """(number of the kind, and what runs_of gives): with two kinds the last bit of a gram is that number."""
    for k, kind in enumerate(kinds):
        for i, a, b, p, g in runs_of(kind, texts):
            yield k, i, a, b, p, g if len(kinds) == 1 else (g & ~U(1)) | U(k)


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def keyed(docs: DataFrame, key: Column) -> DataFrame:
    """The one exchange of texts: doc_id, text, the key that places it, a second hash of the text, all other columns as `rest`.

    Every reading of it takes all of its columns; a constant among them would be folded away in some
    and so make two exchanges of one.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([F.struct(*rest).alias("rest")] if rest else [])
    )
    d = d.withColumns({"key": key, "th": F.xxhash64(F.lit(1), "text")})
    return d.select("doc_id", "text", "key", "th", *(["rest"] if rest else [])).repartition(partitions(docs.sparkSession), "key")


class Counters:
    """At most `size` counters of grams (mergeable; Misra and Gries): a count is short by total / size at most."""

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.g, self.n = np.array([], np.int64), np.array([], np.int64)

    def add(self, g: np.ndarray, n: np.ndarray) -> None:
        self.total += int(n.sum())
        self.g, at = np.unique(np.concatenate([self.g, g]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.g)).astype(np.int64)
        if len(self.g) > self.size:
            n = self.n - np.partition(self.n, -self.size - 1)[-self.size - 1]
            self.g, self.n = self.g[n > 0], n[n > 0]


class Shares:
    """Grams with more than a quarter of a partition's rows, and over how many names each is dealt."""

    def __init__(self, found: dict[int, int], total: int, partitions: int):
        share = total // (4 * partitions) + 1
        large = sorted(g for g, n in found.items() if n > share)
        self.g = np.array(large, np.int64)
        self.parts = np.array([-(-found[g] // share) for g in large], np.uint64)

    def names(self) -> list[tuple[int, int]]:
        """(name, gram) of every part; at most 4 * partitions of them and one for each large gram."""
        return [(int(self._name(np.array([g]), np.array([p], np.uint64))[0]), int(g)) for g, n in zip(self.g, self.parts) for p in range(int(n))]

    @staticmethod
    def _name(g: np.ndarray, part: np.ndarray) -> np.ndarray:
        g = g.view(np.uint64)
        return ((mix(g ^ mix(part + U(1))) & ~U(1)) | (g & U(1))).view(np.int64)  # the last bit says the kind

    def dealt(self, g: np.ndarray, key: int) -> np.ndarray:
        """The names under which a text of this key counts its grams: most grams are their own name."""
        if not len(self.g):
            return g
        at = np.minimum(np.searchsorted(self.g, g), len(self.g) - 1)
        large = self.g[at] == g
        out = g.copy()
        out[large] = self._name(g[large], U(key & 0xFFFFFFFFFFFFFFFF) % self.parts[at[large]])
        return out


def shares(docs: DataFrame, kinds: tuple) -> Shares:
    """Counts the grams of docs(doc_id, text) in bounded counters; what they say decides places of rows, no result."""
    n = partitions(docs.sparkSession)
    size = 16 * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counters(size)
        for b in batches:
            found = [g.view(np.int64) for *_, g in runs_of_kinds(kinds, _raw(b.column(0)))]
            if found:
                held.add(*np.unique(np.concatenate(found), return_counts=True))
        yield pa.RecordBatch.from_arrays([pa.array([None, *held.g.tolist()], pa.int64()), pa.array([held.total, *held.n.tolist()], pa.int64())], SHARES.names)

    # the row without a gram is the total and so the largest; `size` more rows hold every gram of a share
    counted = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count, SHARES).groupBy("g").agg(F.sum("n").alias("n"))
    rows = {r["g"]: r["n"] for r in counted.orderBy(F.desc("n"), F.asc_nulls_first("g")).limit(size + 1).collect()}
    total = rows.pop(None, 0)
    return Shares({g: n + total // size for g, n in rows.items()}, total, n)


Recurs = Callable[[Column, Column, Column], Column]


def recurring_spans(source: DataFrame, docs: DataFrame, kinds: tuple, kernel: Callable, recurs: tuple[Recurs, ...], hot: int, by_document: bool) -> DataFrame:
    """(key, spans): for texts with recurring windows, all of (th, first window, last window, least doc_id, starts).

    Windows count from each of `starts` (see starts_of): what a text repeats is one row.

    docs: from keyed(), of the texts of `source`. kinds: one of Bytes and Words, or two. For each of
    them recurs(count, least, largest) says whether what occurs so often, in documents from the least
    to the largest doc_id (of grams: key), recurs.
    kernel(batches of REGIONS sorted by route and region) gives SPANS.
    Regions and spans of the second kind have ~th for th.
    by_document: the key is the doc_id, recurring means in two documents, and rows without a doc_id
    take no part. Rows of a gram are counted and joined where they lie; those of a gram with more than
    its share lie under several names, whose counts are put together.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    large = shares(source, kinds)

    def either(tag: str, *what: Column) -> Column:
        found = [r(*what) for r in recurs]
        return found[0] if len(kinds) == 1 else F.when(F.col(tag).bitwiseAND(F.lit(1)) == 0, found[0]).otherwise(found[1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(2).to_numpy(zero_copy_only=False), b.column(0)
            out = [(i, *np.unique(g.view(np.int64), return_counts=True)) for _, i, _, _, _, g in runs_of_kinds(kinds, _raw(b.column(1)))]
            if by_document:
                known = ids.is_valid()
                out = [x for x in out if known[x[0]].as_py()]
            if out:
                rows = np.repeat([i for i, _, _ in out], [len(g) for _, g, _ in out])
                named = np.concatenate([large.dealt(g, int(keys[i])) for i, g, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(keys[rows]), pa.array(np.concatenate([n for _, _, n in out]))], GRAMS.names)

    seen = docs.mapInArrow(read, GRAMS).repartition(n, "g")  # both uses take all columns, n too, so that the exchange is one
    counts = seen.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    if names := large.names():
        of = F.broadcast(spark.createDataFrame(names, "g long, whole long"))  # as many rows as names() says
        whole = counts.join(of, "g").groupBy("whole").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        whole = F.broadcast(of.join(whole, "whole").select(F.col("g").alias("part"), *(F.col(c).alias(f"all_{c}") for c in ("n", "texts", "lo", "hi"))))
        counts = counts.join(whole, F.col("g") == F.col("part"), "left").select("g", *(F.coalesce(f"all_{c}", c).alias(c) for c in ("n", "texts", "lo", "hi")))
    used = F.col("lo") <= F.col("hi")  # always; it keeps the key among the columns of this use
    often = counts.filter(either("g", F.col("n"), F.col("lo"), F.col("hi")) & used).select("g", ((F.col("texts") > hot) | (F.col("n") > 8 * hot)).alias("hot"))
    hits = seen.join(often, "g").groupBy("key").agg(F.collect_set(F.struct("g", "hot", "n")).alias("gs"))

    def wanted(batches: Iterator[pa.RecordBatch], often: bool) -> Iterator[tuple]:
        """(kind's number, key, th, doc_id, pieces(), first windows, last windows, anchors, grams) of texts, for their wanted grams."""
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            texts = _raw(col["text"])
            at = col["gs"].offsets.to_numpy()
            fields = dict(zip(("g", "hot", "n"), col["gs"].values.flatten()))
            named, hot = (fields[c].to_numpy(zero_copy_only=False) for c in ("g", "hot"))
            for k, i, a, z, p, g in runs_of_kinds(kinds, texts):
                mine = slice(at[i], at[i + 1])
                signed, key = g.view(np.int64), col["key"][i].as_py()
                take = np.isin(large.dealt(signed, key), named[mine][hot[mine] == often])
                if take.any():
                    found = (x[take].tolist() for x in (a, z, p, signed))
                    th = col["th"][i].as_py()
                    yield k, key, ~th if k else th, col["doc_id"][i].as_py(), kinds[k].pieces(texts[i]), *found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for k, key, th, doc, piece, *found in wanted(batches, False):
            mine: dict[tuple, list[int]] = {}
            for lo, hi, at, gram in zip(*found):
                region = piece(lo, hi + kinds[k].length)
                mine.setdefault((gram, at - lo, region), []).append(lo)
                held += len(region)
                if held > 8 << 20:
                    yield batch([*out, *((key, th, doc, g, at, packed(s), r) for (g, at, r), s in mine.items())], REGIONS)
                    out, held = [], 0
                    mine.clear()
            out.extend((key, th, doc, g, at, packed(s), r) for (g, at, r), s in mine.items())
        if out:
            yield batch(out, REGIONS)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, key, th, doc, piece, *found in wanted(batches, True):
            mine: dict[int, list[int]] = {}
            for lo, hi, _, _ in zip(*found):
                for w in range(lo, hi + 1):
                    h = xxhash.xxh3_128_intdigest(piece(w, w + kinds[k].length))
                    mine.setdefault(h if len(kinds) == 1 else (h & ~1) | k, []).append(w)
                if len(out) + len(mine) > 50_000:
                    yield batch([*out, *((key, th, doc, *halves(h), len(s), packed(s)) for h, s in mine.items())], WINDOWS)
                    out = []
                    mine.clear()
            out.extend((key, th, doc, *halves(h), len(s), packed(s)) for h, s in mine.items())
        if out:
            yield batch(out, WINDOWS)

    def texts(hot: bool) -> DataFrame:
        some = hits.filter(F.exists("gs", lambda x: x["hot"] == F.lit(hot)))
        return docs.join(some.hint("shuffle_hash"), "key").select(*docs.columns, "gs")

    # all regions of a gram in one place: of at most `hot` texts and at most 8 * `hot` of them
    regions = texts(False).mapInArrow(cut, REGIONS).repartition(n, "route").sortWithinPartitions("route", "region")
    cold = regions.mapInArrow(kernel, SPANS)
    windows = texts(True).mapInArrow(every, WINDOWS)
    common = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    common = common.filter(either("h1", F.col("n"), F.col("first"), F.col("last"))).select("h1", "h2", "first")
    # joined on one more key, so that both sides get an exchange of their own: adaptive execution splits only such
    both = F.col("h1").bitwiseXOR(F.col("h2"))
    warm = windows.withColumn("h", both).join(common.withColumn("h", both), ["h", "h1", "h2"]).select("key", "th", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "first", "starts")
    return cold.unionAll(warm).groupBy("key").agg(F.collect_list(F.struct("th", "lo", "hi", "first", "starts")).alias("spans"))


def halves(h: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & 0xFFFFFFFFFFFFFFFF, h >> 64))


def packed(starts: list[int]) -> bytes:
    return np.array(starts, "<i4").tobytes()


def starts_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<i4").tolist()


def windows_of(spans: list[dict] | None, th: int) -> Iterator[tuple[int, int, int | None]]:
    """(first window, last window, least doc_id) of all spans of the text with hash th."""
    for s in spans or []:
        if s["th"] == th:
            for a in starts_of(s["starts"]):
                yield a + s["lo"], a + s["hi"], s["first"]


def batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType.simpleString()]) for c, f in zip(columns, schema)], schema.names)


class Region:
    """A distinct region of a gram: its bytes, anchor, route, and the texts (key, th, doc_id, packed starts) where it stands, `n` times in all."""

    __slots__ = ("text", "at", "route", "places", "n")

    def __init__(self, text: bytes, at: int, route: int):
        self.text, self.at, self.route, self.places, self.n = text, at, route, [], 0


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Region]]:
    """The distinct regions of each route; rows come sorted by route and region."""
    route, held = None, []
    for b in batches:
        for key, th, doc, r, at, starts, region in zip(*(c.to_pylist() for c in b.columns)):
            if r != route:
                if held:
                    yield held
                route, held = r, []
            if not held or held[-1].text != region:
                held.append(Region(region, at, r))
            held[-1].places.append((key, th, doc, starts))
            held[-1].n += len(starts) // 4
    if held:
        yield held


def merged(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Unit ranges covered by windows (first, last): sorted, disjoint, not adjacent."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [tuple(x) for x in out]
