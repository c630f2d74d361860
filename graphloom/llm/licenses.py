"""License scans: phrase places plus an exact set-similarity join of text blocks with license templates.

Everything here is DataFrame and SQL functions. Each text is split into words once; what is kept of it
are the places of words that stand in a phrase or a template. Places of the base phrases follow from
them. For the join, template tokens are ordered by their frequency over the whole corpus, rarest
first. A block is any run of consecutive words as long as a template and a quarter more, across line
breaks. One that holds the threshold share of a template must hold a token of the template's prefix,
so stretches of text are joined to templates on prefix tokens only, then cut by length and position
bounds, and the blocks in what is left are verified by intersection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice templates and the label that the join adds.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "notice:gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "notice:gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "notice:lgpl",
    "licensed under cc by nc 4 0": "notice:cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "notice:cc-by",
    "released under the mit license": "notice:mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "notice:mit",
    "licensed under the apache license version 2 0": "notice:apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "notice:apache",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "notice:bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "notice:isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "notice:mpl",
    "mozilla public license version 2 0": "notice:mpl",
    "this is free and unencumbered software released into the public domain": "notice:public-domain",
    "this work is dedicated to the public domain": "notice:public-domain",
    "distributed under the boost software license version 1 0": "notice:boost",
    "all rights reserved": "notice:reserved",
}

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_TOKENS = 10_000


def as_templates(templates: DataFrame | dict[str, str]) -> dict[str, str]:
    """text to label; the tokens of a table's templates become part of the plan, so there may be at most MOST_TOKENS."""
    if isinstance(templates, dict):
        return templates
    rows = templates.select(F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label")).filter("text is not null and label is not null")
    rows = rows.groupBy("text").agg(F.min("label").alias("label")).limit(MOST_TOKENS + 1).collect()
    out = {" ".join(w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in r["text"]).split()): r["label"] for r in rows}
    return {" ".join(w if not w.isascii() else w.lower() for w in t.split()): label for t, label in out.items() if t}


def scan(docs: DataFrame, threshold: float = 0.8, templates: DataFrame | dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of docs(doc_id, text): word count, base places and labels, added labels, score.

    templates: texts and labels, or a table of them (text, label; null rows are left out). A
    template's label is added where some block holds at least `threshold` of its distinct tokens; a
    block is a run of ceil(5 / 4 * n) words for a template of n words. score: 1 with a base place, else
    the best containment that reached the threshold, else 0. Null and empty texts have no words,
    labels or score. Repeated rows get a row each, and rows of one doc_id are judged by their own
    texts; a null doc_id is like any other. An empty table gives no rows.
    """
    notices = as_templates(templates)
    tokens = {t: sorted(set(t.split())) for t in notices}
    vocabulary = sorted({w for ws in tokens.values() for w in ws} | {w for p in PHRASES for w in p.split()})
    if len(vocabulary) > MOST_TOKENS:
        raise ValueError(f"the templates have more than {MOST_TOKENS} tokens")
    # one row per row of docs, with a number that stays, and the places of words in the vocabulary
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), NOT_WORD).alias("words"))
    found = written(split.select("doc_id", "row", *_words(vocabulary)), "license-words")
    per_row = _matches(found, tokens, notices, threshold).groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    places = {label: _places(phrase) for phrase, label in PHRASES.items()}
    out = found.select("doc_id", "row", "n_words", *(p.alias(f"at {label}") for label, p in places.items())).join(per_row, "row", "left")
    every = F.concat(*(F.col(f"`at {label}`") for label in places))
    base = F.array_compact(F.array(*(F.when(F.size(F.col(f"`at {label}`")) > 0, F.lit(label)) for label in places)))
    labels = F.array_distinct(F.concat(base, F.coalesce("added", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _words(vocabulary: list[str]) -> list[Column]:
    """From the column words: n_words, and as `at` the places (i, w) of words in the vocabulary, in order."""
    words = F.col("words")
    lead = (F.element_at(words, 1) == "").cast("long")  # a text that begins or ends with no word has an empty piece there
    # lower() changes more than A-Z; what becomes a word of the vocabulary with its size kept was ASCII before
    known = lambda w: F.lower(w).isin(vocabulary) & (F.octet_length(F.lower(w)) == F.octet_length(w))
    if not all(w.isascii() for w in vocabulary):
        known = lambda w: _lower(w).isin(vocabulary)
    at = F.array_compact(F.transform(words, lambda w, i: F.when(known(w), F.struct((i.cast("long") - lead).alias("i"), _lower(w).alias("w")))))
    return [F.greatest(F.size(words) - lead - (F.element_at(words, -1) == "").cast("long"), F.lit(0).cast("long")).alias("n_words"), at.alias("at")]


def _lower(w: Column) -> Column:
    return F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(phrase: str) -> Column:
    """Word places where a phrase begins: its words stand one behind the other among the known words too."""
    first, *rest = phrase.split()

    def here(x: Column, k: Column) -> Column:
        cond = x["w"] == first
        for n, w in enumerate(rest, 1):
            y = F.get("at", k + n)
            cond = cond & (y["w"] == w) & (y["i"] == x["i"] + n)
        return F.coalesce(cond, F.lit(False))

    return F.transform(F.filter("at", here), lambda x: x["i"])


def _matches(found: DataFrame, tokens: dict[str, list[str]], notices: dict[str, str], threshold: float) -> DataFrame:
    """(row, label, share): every pair of a row and a template of which one of its blocks holds enough."""
    spark = found.sparkSession
    least = {t: max(1, math.ceil(threshold * len(ws) - 1e-9)) for t, ws in tokens.items()}
    words = {t: -(-5 * len(t.split()) // 4) for t in tokens}
    widest = max(words.values(), default=1)

    # global order: how often each token stands in the corpus; at most one row per template token
    frequency = {r["w"]: r["n"] for r in found.select(F.explode("at.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = []
    for t, label in notices.items():
        ranked = sorted(tokens[t], key=lambda w: (frequency.get(w, 0), w))
        for pos, w in enumerate(ranked[: len(ranked) - least[t] + 1]):
            if w in frequency:
                rows.append((w, label, ranked[pos:], len(ranked), least[t], words[t]))
    schema = "w string, label string, rest array<string>, size int, least int, words int"
    prefixes = spark.createDataFrame(rows, schema)
    heads = sorted({r[0] for r in rows})

    # stretches of the known words: each block begins in one and lies in it whole, for it holds no more of them than words
    stretch = F.expr(f"transform(sequence(0, (size(at) - 1) div {widest}), c -> slice(at, int(c * {widest} + 1), {2 * widest}))")
    blocks = found.filter(F.size("at") >= min(least.values(), default=1)).select("row", F.explode(stretch).alias("b"))
    held = F.array_distinct(F.transform("b", lambda x: x["w"]))
    blocks = blocks.select("row", "b", F.explode(F.array_intersect(held, F.array(*map(F.lit, heads)).cast("array<string>"))).alias("w"))
    # prefix filter; a row per prefix token of a template: at most MOST_TOKENS
    hits = blocks.join(F.broadcast(prefixes), "w")
    # positional filter: blocks with a rarer token of the template are found by that one, so only those behind count
    hits = hits.withColumn("b", F.filter("b", lambda x: F.array_contains("rest", x["w"])))
    # length filter
    hits = hits.filter(F.size(F.array_distinct(F.transform("b", lambda x: x["w"]))) >= F.col("least"))
    # verification: the best block begins at a known word
    within = "transform(filter(slice(b, k + 1, words), y -> y.i < x.i + words), y -> y.w)"
    hits = hits.withColumn("most", F.expr(f"array_max(transform(b, (x, k) -> size(array_distinct({within}))))"))
    return hits.filter("most >= least").select("row", "label", (F.col("most") / F.col("size")).alias("share"))


#: The same in SQL, without prefixes, bounds or stretches: every block that begins at a token of a template is counted.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
templates AS (SELECT unnest([{templates}]) AS x),
tpl AS (SELECT row_number() OVER () AS t, x.label AS label, len(string_split(x.words, ' ')) AS n, list_distinct(string_split(x.words, ' ')) AS tokens FROM templates),
spot AS (SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM w),
tok AS MATERIALIZED (SELECT t, unnest(tokens) AS w FROM tpl),
hit AS MATERIALIZED (SELECT r, t, i, w FROM spot JOIN tok USING (w)),
rare AS (SELECT r, t FROM hit GROUP BY r, t HAVING count(DISTINCT w) >= (SELECT ceil({threshold} * len(tokens) - 1e-9) FROM tpl WHERE tpl.t = hit.t)),
near AS MATERIALIZED (SELECT hit.* FROM hit JOIN rare USING (r, t)),
block AS (SELECT a.r, a.t, a.i, count(DISTINCT b.w) AS most FROM near a JOIN near b ON a.r = b.r AND a.t = b.t AND b.i >= a.i AND b.i < a.i + (SELECT CAST(ceil(n * 1.25) AS BIGINT) FROM tpl WHERE tpl.t = a.t) GROUP BY 1, 2, 3),
added AS (SELECT r, list(DISTINCT label) AS added, max(most / len(tokens)) AS share FROM block JOIN tpl USING (t) WHERE most >= ceil({threshold} * len(tokens) - 1e-9) GROUP BY r),
pos AS (SELECT r, doc_id, len(ws) AS n_words,
  list_filter(range(0, len(ws)), lambda i: ws[i+1] = 'cc' AND ws[i+2] = 'by') AS a,
  list_filter(range(0, len(ws)), lambda i: ws[i+1] = 'general' AND ws[i+2] = 'public' AND ws[i+3] = 'license') AS b,
  list_filter(range(0, len(ws)), lambda i: ws[i+1] = 'all' AND ws[i+2] = 'rights' AND ws[i+3] = 'reserved') AS c FROM w),
base AS (SELECT *, list_concat(list_concat(a, b), c) AS every,
  list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS labels FROM pos)
SELECT base.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base,
  list_min(every) AS first_word, list_max(every) AS last_word,
  array_to_string(list_sort(base.labels), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(added, [])))), ',') AS labels,
  CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN added USING (r)
""".replace("{templates}", ", ".join(f"{{'words': '{w}', 'label': '{label}'}}" for w, label in TEMPLATES.items())).replace("{threshold}", "0.8")
