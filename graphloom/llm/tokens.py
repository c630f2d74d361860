"""Token ids and edit-aware token counts.

A document is lexed once into pre-tokens (special tokens are such of their own); groups of
consecutive pre-tokens are the leaves of a segment tree that holds characters and tokens of each subtree. An edit lexes again only from the
last pre-token that cannot have seen it to the first old boundary behind it; the touched leaves
change and the sums above them are renewed, all else stays.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, ship

#: Fixed value: the pre-token pattern of the byte-level BPE family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def lexer(special: list[str]) -> regex.Pattern:
    """Pre-tokens of a text in which special tokens stand for themselves and end what comes before them."""
    if not special:
        return regex.compile(PATTERN)
    names = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
    # only where a run of characters may go on into a special token it has to look for one
    run = lambda of: f"(?:(?!{names}){of})+" if any(regex.match(of, s) for s in special) else f"{of}+"
    letters, numbers, other = (run(of) for of in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
    return regex.compile(rf"{names}|'s|'t|'re|'ve|'m|'ll|'d| ?{letters}| ?{numbers}| ?{other}|\s+(?:(?={names})|(?!\S))|\s+")


class Encoder:
    """Ids as the tokenizer file gives them; a second, faster library where both must agree.

    The rank file beside the tokenizer file holds the same vocabulary. It serves texts of plain
    characters without special tokens, on which the two libraries' character classes agree.
    """

    odd = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ¡¿ß]")

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.lexer, self.plain = lexer(self.special), lexer([])
        #: A pre-token that ends at e was decided by characters before e + lookahead.
        self.lookahead = max([2, *map(len, self.special)])
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.counts: dict[str, int] = {}

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.odd.search(text) or self.has_special(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token; a piece is encoded once per worker while the memo has room."""
        memo = self.counts
        if len(memo) > 500_000:
            memo.clear()
        for p in set(pieces).difference(memo):
            memo[p] = 1 if p in self.special else len(self.exact.encode(p, add_special_tokens=False).ids if self.fast is None else self.fast.encode_ordinary(p))
        return [memo[p] for p in pieces]


class SegmentTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, text: str, encoder: Encoder, leaf: int = 64):
        self.encoder, self.leaf = encoder, leaf
        # texts without special tokens are lexed faster, until an edit puts one in
        self.lexer = encoder.lexer if encoder.has_special(text) else encoder.plain
        pieces = self.lexer.findall(text)
        counts = encoder.count(pieces)
        self.leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, group in enumerate(self.leaves):
            self.chars[self.size + i] = sum(map(len, group))
            self.tokens[self.size + i] = sum(counts[i * leaf : (i + 1) * leaf])
        for n in range(self.size - 1, 0, -1):
            self._pull(n)
        self.encoded = 0  # characters lexed and encoded again by edits

    def _pull(self, n: int) -> None:
        self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(g) for g in self.leaves)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last one at the end of the text) and where it starts."""
        n, start = 1, 0
        while n < self.size:
            left = self.chars[2 * n]
            if pos < start + left or self.chars[2 * n + 1] == 0:
                n = 2 * n
            else:
                n, start = 2 * n + 1, start + left
        return n - self.size, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of characters start to end (of the text as it is now)."""
        if not 0 <= start <= end <= self.length:
            raise ValueError("edit outside of the text")
        ahead = self.encoder.lookahead
        first, at = self._find(max(0, start - ahead))
        # within the leaf: the last boundary whose pre-tokens before it cannot have seen the edit
        keep, begin = 0, at
        for p in self.leaves[first]:
            if begin + len(p) + ahead > start:
                break
            begin += len(p)
            keep += 1
        if keep == 0 and first and begin > 0:  # the previous leaf's last pre-tokens may have looked this far
            while first and begin + ahead > start and keep == 0:
                first -= 1
                group = self.leaves[first]
                keep = len(group)
                while keep and begin + ahead > start:
                    keep -= 1
                    begin -= len(group[keep])
        last, last_at = self._find(max(begin, end - 1) if end > begin else end)
        last = max(first, min(last, len(self.leaves) - 1))
        # old text from begin to the end of leaf `last`; more leaves are taken until lexing meets an old boundary
        old = self.leaves[first][keep:]
        for i in range(first + 1, last + 1):
            old = old + self.leaves[i]
        if self.lexer is self.encoder.plain:
            around = "".join(old)  # longer than a special token on both sides of the edit, or to the text's ends
            if self.encoder.has_special(around[: start - begin] + new + around[end - begin :] + self._ahead(last)):
                encoded, text = self.encoded, self.text()
                self.__init__(text[:start] + new + text[end:], self.encoder, self.leaf)
                self.encoded = encoded + self.length
                return
        fresh, last = self._relex(old, begin, start, end, new, last)
        self.leaves[first] = self.leaves[first][:keep] + fresh
        for i in range(first + 1, last + 1):
            self.leaves[i] = []
        for i in range(first, last + 1):
            group = self.leaves[i]
            self.chars[self.size + i] = sum(map(len, group))
            self.tokens[self.size + i] = sum(self.encoder.count(group)) if group else 0
        lo, hi = (self.size + first) // 2, (self.size + last) // 2
        while lo:
            for n in range(lo, hi + 1):
                self._pull(n)
            lo, hi = lo // 2, hi // 2
        if len(self.leaves[first]) > 4 * self.leaf:
            encoded, text = self.encoded, self.text()
            self.__init__(text, self.encoder, self.leaf)
            self.encoded = encoded

    def _relex(self, old: list[str], begin: int, start: int, end: int, new: str, last: int) -> tuple[list[str], int]:
        """Pre-tokens for the edited region up to the end of leaf `last`, which may move on."""
        while True:
            text = "".join(old)
            edited = text[: start - begin] + new + text[end - begin :]
            shift = len(new) - (end - start)
            ahead = self._ahead(last)
            bounds, pos = {}, begin
            for k, p in enumerate(old):
                bounds[pos] = k
                pos += len(p)
            fresh, at = [], 0
            for m in self.lexer.finditer(edited + ahead):
                if m.start() >= len(edited):
                    break
                was = begin + m.start() - shift
                if was >= end and was in bounds:  # an old boundary behind the edit: what follows is as before
                    self.encoded += m.start()
                    return fresh + old[bounds[was] :], last
                if m.end() > len(edited):  # it runs into the next leaf
                    at = -1
                    break
                fresh.append(m.group())
                at = m.end()
            if at >= 0:
                self.encoded += len(edited)
                return fresh, last
            last += 1
            old = old + self.leaves[last]

    def _ahead(self, last: int) -> str:
        """Text behind leaf `last`, long enough to see how its last pre-token ends."""
        out = []
        for i in range(last + 1, len(self.leaves)):
            out.extend(self.leaves[i])
            if len(out) >= 3 and sum(map(len, out)) > self.encoder.lookahead:
                break
        return "".join(out)


#: What the redaction edits replace.
PRIVATE = re.compile(
    r"(?P<mail>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?P<number>(?<![\w.])\+?\d(?:[ -]?\d){6,}(?![\w]))"
    r"|(?P<key>\b(?=[A-Za-z]*\d)[A-Za-z0-9_]{20,}\b)"
)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that take mail addresses, long numbers and keys out of a text, in text order."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in PRIVATE.finditer(text)]


COUNTS = "doc_id long, n_chars long, n_tokens long, n_edits int, n_chars_after long, n_tokens_after long, n_chars_reencoded long"


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    edits: DataFrame | None = None,
    propose: Callable[[str], list[tuple[int, int, str]]] = redactions,
) -> DataFrame:
    """Token counts of every document before and after its edits.

    edits(doc_id, start, end, new): places in the original text that do not overlap; without it,
    propose(text) gives them. Null and empty texts have no tokens; edits of unknown documents have
    no effect; edits that overlap or lie outside of the text raise an error; null edits are skipped.
    Repeated rows are counted each.
    """
    ship(docs.sparkSession)
    d = documents(docs)
    given = edits is not None
    if given:
        per = edits.filter("doc_id is not null and start is not null and end is not null").groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new")))).alias("edits")
        )
        d = d.join(per.withColumnRenamed("doc_id", "edited"), F.col("doc_id") == F.col("edited"), "left").select("doc_id", "text", "edits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                changes = propose(text) if not given else [(e["start"], e["end"], e["new"]) for e in b.column(2)[i].as_py() or []]
                tree = SegmentTree(text, enc)
                chars, before = tree.length, tree.total
                done = chars
                for start, end, new in reversed(changes):  # from the back: places in front stay as they were
                    if end > done:
                        raise ValueError("edits overlap")
                    tree.replace(start, end, new)
                    done = start
                out.append((b.column(0)[i].as_py(), chars, before, len(changes), tree.length, tree.total, tree.encoded))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in COUNTS.split(", ")])

    return d.mapInArrow(work, COUNTS)
