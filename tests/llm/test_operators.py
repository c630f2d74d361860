"""Corpus operators against plain models, and on odd rows."""

import hashlib
import math
import random
import re
import timeit
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute import brute_cut
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import decontam, html_extract, licenses, packing, phrase_dedup, queries, simhash, suffix_dedup, tokens, topk, toxicity
from graphloom.llm.recur import Counters, Shares, anchored_runs

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, score double, key long, spans string, n_chars long"


def frame(spark, rows):
    """rows of (doc_id, text), with columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, None, 0.5, 1, "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


LONG = " ".join(f"w{i % 977} x{i % 1009}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same words here"), (5, "same words here"), (None, "same words here"), (6, "é" * 900 + "x" * 900), (7, "one"), (8, "<|endoftext|> \x85   cc by")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# token counts


def test_segment_tree_follows_any_edits(exact):
    enc = tokens.Encoder(PATH)
    rnd = random.Random(5)
    parts = ["a", "b ", " ", "  ", "'", "'re", "\n", "1", "23", "!!", "é", "ll", "x y", "<|endoftext|>", "<|endof", "text|>", "<", "|>", " <"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        tree = tokens.SegmentTree(text, enc, leaf=rnd.choice([1, 2, 4, 64]))
        for _ in range(4):
            a = rnd.randint(0, len(text))
            b = min(len(text), a + rnd.randint(0, 6))
            new = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4)))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(exact.encode(text, add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        tree.replace(0, 10**6, "")


def test_token_counts(spark, docs, exact):
    rows = {r.doc_id: r for r in tokens.token_counts(docs, PATH).collect()}
    for r in docs.select("doc_id", "text").collect():
        text = r.text
        for a, b, new in reversed(tokens.redactions(text)):
            text = text[:a] + new + text[b:]
        got = rows[r.doc_id]
        assert got.n_tokens == len(exact.encode(r.text, add_special_tokens=False).ids)
        assert got.n_tokens_after == len(exact.encode(text, add_special_tokens=False).ids)
        assert got.n_chars_after == len(text)
    assert any(r.n_edits and r.n_chars_reencoded < r.n_chars / 4 for r in rows.values())


def test_token_counts_with_given_edits(spark, odd, none):
    edits = spark.createDataFrame([(5, 0, 4, "other"), (5, 15, 15, "!"), (99, 0, 1, "x"), (None, 0, 1, "x"), (7, 0, 3, None)], "doc_id long, start long, end long, new string")
    rows = tokens.token_counts(odd, PATH, edits).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.n_chars_after for r in rows if r.doc_id in (5, 7)) == [0, 17, 17]
    assert tokens.token_counts(none, PATH).count() == 0
    with pytest.raises(Exception, match="overlap"):
        tokens.token_counts(odd, PATH, spark.createDataFrame([(5, 0, 4, ""), (5, 2, 6, "")], edits.schema)).collect()


# top-k


def brute_top(rows, k):
    v = {}
    for i, e in rows:
        if e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.setdefault(i, []).append([math.floor(256 * x) for x in e])
    out = set()
    for q in v:
        if q % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v[q][0], x)), i) for i, xs in v.items() for x in xs if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(421, None), (422, [1.0, None] + [0.0] * 6), (423, [float("nan")] * 8), (424, [float("inf")] * 8), (450, [0.0] * 8)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    for shard, block in ((80_000, 10_000), (400, 3)):
        got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard, block).collect()}
        assert got == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e300], 1)], df.schema), F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_repeated_ids(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(q, rows[q][1]) for q, copies in ((0, 5), (50, 9), (100, 1), (150, 40)) for _ in range(copies)]  # queries
    rows += [(i, rows[50][1]) for i in (7, 7, 7, 301, 302, 303, 304, 305, 306)] + [(11, rows[11][1])] * 8  # others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_top(rows, 5)
    assert Counter(q for q, *_ in want) == {q: 5 for q in range(0, 300, 50)}
    for shard in (80_000, 400):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard).collect()} == want
    # more rows than a shard scores outright, two vectors under one id
    many = [(i, [rnd.gauss(0, 0.3) for _ in range(12)]) for i in range(1500)]
    many += [(q, many[q][1]) for q, copies in ((0, 5), (50, 49)) for _ in range(copies)] + [(100, [3.0] * 12), (100, [-3.0] * 12)]
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    least = [(100, min(e for i, e in many if i == 100))]  # asks, for it is the least array
    want = brute_top(least + [r for r in many if r != least[0]], 5)
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()} == want
    # a proof before the last segment: own copies must not lift the floor
    ids, values = np.array([0] * 8 + list(range(1, 4000))), np.random.default_rng(1).integers(-99, 99, (4007, 16))
    values[:8] = values[0]
    (_, got, scores), = topk.Shard(ids, values, 5).search(np.array([0]), values[:1], 5, few=5)
    best = topk.top_of(got, scores, 5)
    exact = values[8:] @ values[0]
    assert scores[best].tolist() == sorted(exact.tolist())[:-6:-1]


# decontamination


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((30, 45, 20, 3))] + [(10, "abc"), (11, ""), (12, None)]

    def typed(t, edits):
        t = list(t)
        for _ in range(edits):
            p = rnd.randrange(len(t))
            t[p : p + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
        return "".join(t)

    rows = [(n, prose(60)) for n in range(10)]
    for n, (i, edits) in enumerate(((0, 0), (0, 4), (1, 6), (1, 30), (2, 3), (3, 0), (2, 12))):
        rows.append((20 + n, f"{prose(20)}\n {typed(items[i][1], edits)}  {prose(20)}"))
    rows += [(40, items[1][1].upper()), (41, items[1][1][:170]), (42, items[0][1][:60]), (43, "x abc y"), (44, None), (45, ""), (46, items[0][1]), (46, items[0][1])]
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = brute_passages(rows, items)
    for shard in (10**6, 200):
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, shard_chars=shard).collect()} == want
    for shard in (10**6, 200):
        clean = decontam.clean(df, bench, shard_chars=shard)
        assert clean.columns == df.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in {a for a, _ in want})
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def holds_window(item, text, length, most):
    """Whether text holds, within `most` edits, some `length` units in a row of item; both as sequences."""
    if len(item) < length:
        return False
    ids = {}
    a, b = (np.array([ids.setdefault(u, len(ids)) for u in x], int) for x in (item, text))
    of = np.lib.stride_tricks.sliding_window_view(a, length)
    row, steps = np.zeros((len(of), len(b) + 1), int), np.arange(len(b) + 1)
    for i in range(length):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (of[:, i, None] != b))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return bool(row.min() <= most)


def brute_passages(rows, items):
    """Without any of the operator's own functions: every window, against every place of every text."""
    norm = lambda t: " ".join((t or "").lower().split())
    out = set()
    for d, t in rows:
        for i, b in items:
            x, y = norm(b), norm(t)
            if len(x) < 10:  # as it stands
                out |= {(d, i)} if x and x in y else set()
                continue
            size = {min(80, len(x)), len(x) if len(x) <= 120 else 80}
            w = min(13, len(x.split()))
            by_word = w >= 8 and holds_window(x.split(), y.split(), w, w // 6)
            if by_word or any(holds_window(x, y, n, min(int(n * 0.06), (n - 10) // 10)) for n in size):
                out.add((d, i))
    return out


def test_leaks_wherever_a_passage_begins(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((40, 45, 19, 14, 9))]
    rows, sure = [], set()

    def put(i, passage, is_sure=False):
        if is_sure:
            sure.add((len(rows), i))
        rows.append((len(rows), f"{prose(rnd.randint(0, 20))} {passage} {prose(rnd.randint(0, 20))}"))

    for i, t in items[:4]:
        for at in range(0, len(t) - 79, 13):
            put(i, t[at : at + 80], len(t[at : at + 80].strip()) == 80)
            put(i, t[at : at + 40] + rnd.choice(["", "z", "zz"]) + t[at + 41 : at + 79])
            put(i, t[at : at + 70])
    for i, t in items:
        for every in (5, 8, 10, 12):
            words = [word() if n % every == every // 2 else w for n, w in enumerate(t.split())]
            put(i, " ".join(words), every >= 8 and i < 3)
    want = brute_passages(rows, items)
    assert sure <= want and len(want) < len(rows)
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0 <= r.first_char < r.end_char <= len(rows[r.doc_id][1]) and r.n_segments >= 1 for r in got)
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


# toxicity


def test_toxicity_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(d, labels).filter("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    toxic, other = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([[(t > o) + 0.5 * (t == o) for o in other] for t in toxic])
    assert auc > 0.9
    assert sum(r.predicted for r in rows if not r.toxic) < 0.04 * len(other)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_sample_is_one_text_of_a_document(spark):
    rnd = random.Random(9)
    prose = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    plain = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    bad = [f"zq{i}xk" for i in range(12)]
    rows = [(d, prose(plain + bad * 8 if d % 4 == 0 else plain, 80)) for d in range(400)]
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(400)] + [(9_999, 1), (8, 0)], "doc_id long, toxic int")
    once = toxicity.train(frame(spark, rows), labels)
    again = toxicity.train(frame(spark, rows[::-1] + rows[:40] * 30), labels)  # order and repeats of rows change nothing
    assert once == again and once.weights
    few = toxicity.train(frame(spark, rows), labels, toxic_rows=30, other_rows=60)
    assert few != once and toxicity.train(frame(spark, rows), labels, toxic_rows=30, other_rows=60) == few
    with pytest.raises(ValueError):
        toxicity.score(frame(spark, rows), once)
    scored = toxicity.score(frame(spark, rows).drop("score"), once).collect()
    by = {r.doc_id: r for r in scored}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(by[d].predicted == int(d % 4 == 0) for d in held) >= 0.95 * len(held)
    # the score again from plain compression
    plain_of, both_of = toxicity.lengths(once.ordinary), toxicity.lengths(once.both)
    for d, t in rows[:12]:
        w = (" " + " ".join(re.findall(r"\w+", t.lower())) + " ").encode()
        saved = [plain_of(w[i : i + 80]) - both_of(w[i : i + 80]) for i in range(0, len(w), 64)]
        tail = [(k, len(saved) * once.rates[n]) for n in range(1, 13) for k in [sum(x >= n for x in saved)]]
        surprise = max([0, *(k * math.log(k / u) - k + u for k, u in tail if k > u)])
        z = once.weights[0] + once.weights[1] * math.sqrt(surprise) + once.weights[2] * sum(saved) / math.sqrt(len(saved))
        assert by[d].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0


@pytest.mark.parametrize("short", ["", "a", "hi", "abc", "\u00e4\u00f6", "abcd", "abcde", "..."])
def test_toxicity_learns_beside_texts_shorter_than_a_gram(short):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(" ".join(rng.choices(words, k=60) + ["vileslur horridinsult"] * 3 * y), y) for y in [0, 1, 0, 0] * 40]
    totals = {0: 122, 1: 42}
    with_short = toxicity.fit([(short, 0), (short, 1), *rows, (short, 0), (short, 1)], totals)
    scorer = toxicity.Scorer(with_short)
    assert with_short.weights and 0 <= scorer.score(short) <= 1
    right = [(scorer.score(t) >= 0.5) == y for t, y in rows]
    assert sum(right) > 0.95 * len(right)


# near duplicates


def brute_fingerprint(text, k=3):
    w = [x for x in (text or "").encode().lower().split()]
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def brute_components(fps):
    """(doc_id, fingerprint) pairs to the smallest doc_id reachable."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), d), d)
    return {fps[i][0]: low[find(i)] for i in range(len(fps))}


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + r, t) for r, t in ODD[:4]]
    rows += [(2000 + n, rows[3][1] + f" tail{n}") for n in range(5)]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_components(fps)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in fps}


@pytest.mark.parametrize("hot", [64, 2, 0])
def test_links_of_crowded_lists(spark, hot):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(150):
        x = rnd.choice(sorted(values))
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(64)
        values.add(x)
    values |= {rnd.getrandbits(64) for _ in range(50)}
    fps = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(simhash.signed(f), d) for d, f in fps], "fp long, rep long")
    from graphloom.llm.common import connected_components

    roots = {r.node: r.root for r in connected_components(simhash.links(df, hot)).collect()}
    assert {d: roots.get(d, d) for d, _ in fps} == brute_components(fps)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1 and by[None].component_id is None and by[5].component_id == 5
    assert simhash.near_duplicates(none).count() == 0


# repeated windows


def brute_phrases(rows, length):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def brute_bytes(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(b[i : i + length]) for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def some_copies(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [prose(rnd.randint(5, 60)) for _ in range(6)]
    rows = []
    for d in range(60):
        text = prose(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            text += rnd.choice(shared) + prose(rnd.randint(0, 12))
        rows.append((d, rnd.choice([" ", "  ", "\n"]).join(text)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (None, rows[6][1]), (102, None), (103, ""), (104, "a " * 300), (105, "ab" * 700), (106, "é" * 500)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_windows(spark, hot):
    rows = some_copies(hot)
    df = frame(spark, rows)
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in phrase_dedup.remove_phrases(df, 13, hot).collect()]
    assert Counter(got) == Counter(brute_phrases(rows, 13))
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 60, hot).collect()]
    assert Counter(got) == Counter(brute_bytes(rows, 60))


def brute_shared_words(rows, words):
    """Words of each row in strings of `words` words that rows of two doc_ids hold."""
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    held = {}
    for d, w in texts:
        for i in range(len(w) - words + 1):
            held.setdefault(tuple(w[i : i + words]), set()).add(d)
    out = []
    for _, w in texts:
        in_one = set()
        for i in range(len(w) - words + 1):
            if len(held[tuple(w[i : i + words])] - {None}) > 1:
                in_one.update(range(i, i + words))
        out.append(len(in_one))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("length, words", [(60, 13), (20, 2), (400, 51)])
def test_passages_of_words_beside_strings_of_bytes(spark, length, words, hot):
    rows = some_copies(3) + [(200, "b " * 90), (None, "c " * 90), (None, "c " * 90), (201, "d " * 90), (201, "d " * 95), (None, "d " * 60), (202, "e\u00a0f " * 80), (203, "e\u00a0f\t" * 80)]
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept), r.n_passage_words) for r in suffix_dedup.remove_repeats(frame(spark, rows), length, hot, words).collect()]
    want = [(*b, n) for b, n in zip(brute_bytes(rows, length), brute_shared_words(rows, words))]
    assert Counter(got) == Counter(want) and (words > 13 or any(x[5] for x in want))


def test_op8_tells_of_passages_shorter_than_its_strings(spark, tmp_path):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    sizes = (51, 53, 60, 90)
    passages = [prose(n) for n in sizes]
    rows = [(d, f"{prose(40)} {passages[d % 4]} {prose(30)}") for d in range(24)] + [(100 + d, prose(120)) for d in range(10)]
    rows += [(200, prose(50)), (201, None), (202, "")]
    rows += [(203, rows[-3][1])]  # of 50 words only
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(d, got[d].n_passage_words) for d, _ in rows] == [(d, sizes[d % 4] if d < 24 else 0) for d, _ in rows]
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in map(got.get, (d for d, _ in rows))] == [b[:4] for b in brute_bytes(rows, 400)]
    assert all(len(p.encode()) < 400 and got[d].n_removed == 0 for p, d in zip(passages[:3], range(3)))


def test_windows_shorter_than_a_gram(spark):
    rows = some_copies(2)
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows), 20).collect()]
    assert Counter(got) == Counter(brute_bytes(rows, 20))


def test_rows_without_repeats(spark):
    rows = [(1, "x" + "abcdé" * 30 + "left"), (2, "abcdé" * 30), (3, None), (4, "alone")]
    out = suffix_dedup.without_repeats(frame(spark, rows), 60, whole=60)
    assert out.columns == SCHEMA.replace(" ", ",").split(",")[0::3] or out.columns == frame(spark, rows).columns
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in out.collect()}
    assert got[4] == ("alone", 5, "s") and got[3][0] == "" and got[1] == (rows[0][1], len(rows[0][1]), "s")
    assert 2 not in got


@pytest.mark.parametrize("hot", [4_000, 2])
def test_passages_of_earlier_documents_go(spark, hot):
    rows = some_copies(11)
    got = [(r.doc_id, r.text) for r in suffix_dedup.without_repeats(frame(spark, rows), 40, 20, 90, hot).collect()]
    assert Counter(got) == Counter(brute_cut(rows, 40, 20, 90))


def test_planted_passages_of_over_fifty_words(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passages = [prose(n) for n in (51, 53, 60, 90)]
    rows = [(d, f"{prose(40)} {passages[d % 4]} {prose(30)}") for d in range(24)] + [(100 + d, prose(120)) for d in range(10)]
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert all(sum(p in t for t in got.values()) == 1 for p in passages) and all(passages[d] in got[d] for d in range(4))
    assert all(got[d] == t for d, t in rows if d >= 100) and all(got[d][:100] == t[:100] for d, t in rows)


@pytest.mark.parametrize("parts", [1, 8])
def test_counters_miss_no_large_gram(parts):
    rnd = np.random.default_rng(parts)
    g = np.concatenate([np.full(5_000, 7), np.full(900, -3), rnd.integers(0, 1 << 40, 20_000)])
    rnd.shuffle(g)
    held = Counters(50)
    for part in np.array_split(g, 40):
        held.add(*np.unique(part, return_counts=True))
    assert held.total == len(g) and len(held.g) <= 50
    counted = dict(zip(held.g.tolist(), held.n.tolist()))
    assert 5_000 - len(g) // 50 <= counted[7] <= 5_000 and 900 - len(g) // 50 <= counted.get(-3, 0) <= 900
    s = Shares({7: 5_000, -3: 900, 5: 1}, len(g), 4 * parts)
    names = dict(s.names())
    out = [int(s.dealt(np.array([7, 5]), key)[0]) for key in range(500)]
    assert {names[x] for x in out} == {7} and len(set(out)) == int(s.parts[s.g.tolist().index(7)]) > 1
    assert all(s.dealt(np.array([5]), key)[0] == 5 for key in range(9))


def test_repeats_of_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.n_words, sum(x.end - x.start for x in r.spans), r.kept) for r in phrase_dedup.remove_phrases(odd).collect()]
    assert Counter(got) == Counter(brute_phrases(ODD, 13))
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert Counter(got) == Counter(brute_bytes(ODD, 400))
    assert phrase_dedup.remove_phrases(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0


def test_deep_shallow_sorts():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 80))) for _ in range(300)] + [b"a" * n for n in range(60)] * 2
    assert [strings[i] for i in suffix_dedup.deep_shallow(strings)] == sorted(strings)


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 4, 200).astype(np.uint64)
    b = np.concatenate([rnd.integers(0, 4, 33).astype(np.uint64), a])
    units = np.concatenate([a, b])
    t, lo, hi, at, g = anchored_runs(units, np.array([0, 200]), np.array([200, 233]), 20, 4)
    of = {(int(x), w): (int(p) - w, int(h)) for x, l, z, p, h in zip(t, lo, hi, at, g) for w in range(int(l), int(z) + 1)}
    assert all(of[0, w] == of[1, w + 33] for w in range(181)) and len(of) == 181 + 214


# licences


WRAPPED = "Redistribution and use in source and\n * binary forms, with or without\n * modification, are permitted provided that\n * the following conditions are met:"
LICENSED = [(1, None), (2, ""), (3, "CC BY cc-by. CC  BY"), (4, "ccby xcc by"), (5, "The General PUBLIC license\nall rights reserved ALL RIGHTS RESERVED"), (6, "Licensed under the Apache License, Version 2.0.\nx")]
LICENSED += [(7, "under the apache license version\nreleased under MIT license"), (8, "é cc by É"), (9, "version 2 license apache the under licensed 0"), (10, LONG + " cc by"), (11, "\n\n  \n"), (12, "all rights all rights reserved")]
LICENSED += [(13, WRAPPED), (14, "Released under\nthe MIT License."), (15, "released " + "x " * 9 + "the mit license"), (16, "\u212ac by c\u212a"), (17, "Licensed under the " * 300 + "x apache license version 2 0"), (18, "x " * 700 + WRAPPED + " y" * 700)]
LICENSED += [(19, "Released under the MIT License."), (19, "nothing here"), (19, "nothing here"), (None, "Released under the MIT License."), (None, "cc by"), (20, "free software " * 2000)]


def brute_licences(text):
    """labels and score of a text: each block of each template, by sets."""
    words = re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", text or "")
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    base = {label for p, label in licenses.PHRASES.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
    labels, best = set(base), 0.0
    for t, label in licenses.TEMPLATES.items():
        want, size = set(t.split()), math.ceil(1.25 * len(t.split()))
        share = max((len(want & set(words[i : i + size])) / len(want) for i, w in enumerate(words) if w in want), default=0)
        if share >= 0.8 - 1e-9:
            labels.add(label)
            best = max(best, share)
    return ",".join(sorted(labels)), 1.0 if base else best


def test_license_scan(spark):
    import duckdb

    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in licenses.scan(frame(spark, LICENSED)).collect()), key=key)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LICENSED)
    assert got == sorted(con.execute(licenses.ORACLE).fetchall(), key=key)
    assert Counter((r[0], r[6], r[7]) for r in got) == Counter((d, *brute_licences(t)) for d, t in LICENSED)
    by = {r[0]: r for r in got}
    assert by[3][2:5] == (3, 0, 4) and by[5][5] == "gpl,reserved" and by[6][6] == "notice:apache"
    assert by[13][6] == by[18][6] == "notice:bsd" and by[14][6] == "notice:mit" and by[15][6] == ""
    assert sorted(r[6] for r in got if r[0] == 19) == ["", "", "notice:mit"]


def test_license_templates_as_a_table(spark):
    table = spark.createDataFrame([("Do as  you LIKE, with this!", "own:free"), (None, "x"), ("y", None)], "text string, label string")
    rows = [(1, "you may do as you\nlike with this"), (2, "do as you"), (3, None)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, rows), templates=table).collect()}
    assert got == {1: ("own:free", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    assert licenses.scan(frame(spark, rows), templates={}).filter("labels <> ''").count() == 0


def test_license_scan_of_odd_rows(spark, odd, none):
    rows = licenses.scan(odd).collect()
    assert Counter((r.doc_id, r.labels, r.score) for r in rows) == Counter((d, *brute_licences(t)) for d, t in ODD)
    assert licenses.scan(none).count() == 0


# pages

ARTICLE = "<article><h1>Title &amp; more</h1><p>First, with a comma, and more words to be a paragraph.<p>Second&nbsp;one\n  has <b>bold</b> text<br>and a break.<ul><li>a<li>b</ul></article>"
EXPECTED = "Title & more\n\nFirst, with a comma, and more words to be a paragraph.\n\nSecond one has bold text and a break.\n\na\n\nb"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""), ("   ", ""), ("plain &lt;text&gt;", "plain <text>"), (ARTICLE, EXPECTED), ("<p>a<p>b", "a\n\nb"), ("<div><p>unclosed <b>bold", "unclosed bold"),
        (f'<html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>{ARTICLE}<footer>&copy; x</footer></body></html>', EXPECTED),
        (f'<body><header><p>site, name, and, so, on, for, a, long, line</p></header><aside class="sidebar"><p>links, links, links, links and more of them</p></aside>{ARTICLE}<section id="comments"><p>I say, well, this is a comment of a reader.</p></section><form><p>Your name, please, in this field here now</p></form></body>', EXPECTED),
        ('<div class="content"><p>Hello, world, this is long enough to count.</p><p>Short.</p></div><div class="menu"><p>menu, menu, menu, menu, menu, menu, menu</p></div>', "Hello, world, this is long enough to count.\n\nShort."),
        ('<div class="page has-sidebar"><p>Kept, since this wraps the whole page here.</p></div>', "Kept, since this wraps the whole page here."),
        ('<div><p><a href="x">one, two, three, four, five, six, seven, eight</a></p></div><div><p>Real text, which has no links, is what counts here.</p></div>', "Real text, which has no links, is what counts here."),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


class Article(HTMLParser):
    """The blocks of the article element: what stands in it between starts and ends of h1, p, li and the like."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks[-1] += " " if tag == "br" else ""
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div", "blockquote"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div", "blockquote"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_against_their_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: "\n\n".join(filter(None, (" ".join(x.split()) for x in Article(r.html).blocks))) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()} and sum(map(len, want.values())) > 10_000


@pytest.mark.parametrize("part", ['<a "', "<", "<div><p>", "<b>", '<a "> "', "</script ", "<p class=   ", "<b>x<hr>", "<body>x", "<li><b>x", "&am<b>p;"])
def test_time_grows_with_the_page_alone(part):
    def seconds(n):
        html = part * (n // len(part))
        return min(timeit.repeat(lambda: html_extract.main_text(html), number=1, repeat=2))

    assert seconds(400_000) < 8 * seconds(100_000) + 0.2  # four times as long; with the square it would be 16


def test_references_do_not_run_over_markup():
    assert html_extract.main_text("<p>&am<b>p;</b> &lt;x&gt; &amp;lt;</p>") == "&amp; <x> &lt;"


def test_extraction_of_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ARTICLE), (2, "u", "<p>" * 30_000 + "deep"), (2, "u", "<p>" * 30_000 + "deep"), (3, "u", "<" * 1000), (4, "u", "<div>" * 2000 + "x" + "</div>" * 2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = html_extract.extract(df).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id is None} == {EXPECTED} and out[0].text == ""
    assert html_extract.extract(df.limit(0)).count() == 0


# packing


def check_packing(rows, pieces, exact, capacity):
    by_seq, by_doc = {}, {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r.piece)
        k = len({r.piece for r in mine})
        assert len(mine) == k * sum(1 for x, _ in rows if x == d)
        mine = mine[:: len(mine) // k]
        assert mine[0].start == 0 and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.piece == 0 or r.length == capacity
    return len(by_seq)


def test_packing(spark, docs, exact):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for capacity in (2048, 256):
        pieces = packing.pack_documents(docs, PATH, capacity).collect()
        bins = check_packing(rows, pieces, exact, capacity)
        assert bins - packing.lower_bound(np.array([r.length for r in pieces]), capacity) <= 1


def test_rounds_of_repacking(spark):
    rnd = random.Random(9)
    rows = [(i, 0, 0, 0, rnd.choice([1, 300, 700, 701, 900, 1025, 2048]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, packing.PIECES)
    lengths = np.array([r[4] for r in rows])
    few = packing.pack(df, per_partition=50, shrink=2).collect()
    alone = packing.pack(df).select("sequence_id").distinct().count()
    by = {}
    for r in few:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(few) == 400 and all(sum(n for _, n in p) <= 2048 for p in by.values())
    assert packing.lower_bound(lengths, 2048) <= alone <= len(by) <= alone + 3


def test_lower_bound_is_one():
    rnd = random.Random(1)
    for _ in range(200):
        n = [rnd.randint(1, 12) for _ in range(rnd.randint(1, 6))]
        best = min(fewest(n, 12))
        assert packing.lower_bound(np.array(n), 12) <= best <= len(packing.best_fit_decreasing(np.array(n), 12)[2])


def fewest(n, capacity):
    def go(i, bins):
        if i == len(n):
            yield len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + n[i] <= capacity:
                yield from go(i + 1, (*bins[:j], bins[j] + n[i], *bins[j + 1 :]))
        yield from go(i + 1, (*bins, n[i]))

    return go(0, ())


def test_packing_of_odd_rows(spark, odd, none, exact):
    rows = [(d, t) for d, t in ODD]
    check_packing(rows, packing.pack_documents(odd, PATH).collect(), exact, 2048)
    assert packing.pack_documents(none, PATH).count() == 0
