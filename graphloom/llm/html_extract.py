"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their parent and, halved, to its parent; a
container's points are discounted by the share of its text in links. The best container, widened to
the article element around it, and its siblings that score well too are kept; navigation, page
furniture, forms, scripts and reader comments are left out wherever they stand. Reading and scoring take time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_OPEN = re.compile(r"<(?:/?[a-zA-Z]|[!?/])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>\"']*)>")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")

#: Element names.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head script style noscript template iframe svg canvas math object nav header footer aside form button select option textarea fieldset dialog menu title audio video".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body"}
SCOPE = set("article section div main td th table blockquote body html aside nav header footer form ul ol dl figure".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

PARAGRAPH = set("p pre blockquote li h1 h2 h3 h4 h5 h6 td dd".split())
NO_CONTAINER = set("p li h1 h2 h3 h4 h5 h6".split())

#: Words of class, id and role that mark page furniture.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion promoted reply replies related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ALWAYS = {"comment", "comments", "commentlist", "disqus", "replies"}
CONTENT = {"article", "main", "content", "post", "entry", "story", "body", "has", "with", "page"}


class Node:
    """An open or closed element. text, linked: characters in it, and those in links; of its own blocks, later of all below."""

    __slots__ = ("tag", "parent", "block", "gone", "points", "text", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None, gone: bool):
        self.tag, self.parent, self.gone = tag, parent, gone
        self.block: Node = self if parent is None or tag in BLOCK else parent.block  # the innermost block element
        self.points, self.text, self.linked, self.kept = 0.0, 0, 0, False


def _furniture(attrs: str) -> bool:
    words = set()
    for m in _NAMES.finditer(attrs):
        words.update(_TOKEN.findall((m[1] or m[2] or m[3] or "").lower()))
    return bool(words & ALWAYS) or bool(words & FURNITURE) and not words & CONTENT


def _spaced(text: str) -> str:
    return " ".join(text.split())


class Markup:
    """Reads a page from front to back: pieces of text and tags. No part is looked at more than a few times."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.unclosed = -1  # behind tags in front of this place no > stands outside of quotes: they end at the first

    def _tag_end(self, at: int) -> int:
        """Where the > of the tag stands whose name ends at `at`: one outside of quotes, if the quotes are closed."""
        i = at
        while i > self.unclosed:
            m = _STOP.search(self.html, i)
            if m is None:
                self.unclosed = len(self.html)
                break
            if m[0] == ">":
                return m.start()
            end = self.html.find(m[0], m.end())
            if end < 0:
                self.unclosed = m.start()
                break
            i = end + 1
        return self.html.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose text is not markup."""
        m = _raw(tag).search(self.html, at)
        end = self.html.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.html)

    def parts(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, text or name, attributes, where it ends): kind is text, plain (no references in it), open or close.

        After an open element whose text is not markup the reader sets `at` itself.
        """
        html, size = self.html, len(self.html)
        self.at = 0
        while self.at < size:
            m = _OPEN.search(html, self.at)
            lt = m.start() if m else size
            if lt > self.at:
                yield "text", html[self.at : lt], "", lt
            self.at = lt
            if m is None:
                return
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                self.at = end + 3 if end >= 0 else size
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt)
                yield "plain", html[lt + 9 : end if end >= 0 else size], "", lt
                self.at = end + 3 if end >= 0 else size
            elif lt > self.last:  # no tag ends any more: what is left is text and comments
                end = html.find("<!--", lt)
                self.at = end if end >= 0 else size
                yield "text", html[lt : self.at], "", self.at
            elif m[0][-1].isalpha():
                t = _PLAIN.match(html, lt)
                if t:
                    name, attrs, self.at = t[1], t[2], t.end()
                else:
                    t = _NAME.match(html, lt)
                    end = self._tag_end(t.end())
                    name, attrs, self.at = t[1], html[t.end() : end], end + 1
                yield "close" if html[lt + 1] == "/" else "open", name.lower(), attrs, self.at
            else:
                self.at = html.find(">", lt) + 1


@cache
def _raw(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b", re.I)


class Tree:
    """Elements and text blocks of a page; blocks are (text, innermost block element), without dropped subtrees."""

    def __init__(self, html: str):
        root = Node("html", None, False)
        self.nodes = [root]  # parents before children
        self.blocks: list[tuple[str, Node]] = []
        self.stack = [root]  # open elements, inline ones too
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.scopes = [0]  # places of the elements that end a search for an open one
        self.parts: list[str] = []
        self.links = 0  # open links
        self.linked = 0  # characters of the current block inside links
        markup = Markup(html)
        for kind, name, attrs, _ in markup.parts():
            if kind == "text":
                self.say(unescape(name) if "&" in name else name)
            elif kind == "plain":
                self.say(name)
            elif name == "br":
                self.say(" ")
            elif kind == "close":
                self.close(name)
            elif self.start(name, attrs):
                markup.at = markup.raw_end(name, markup.at)
        self.flush()

    def say(self, s: str) -> None:
        if s and not self.stack[-1].gone:
            self.parts.append(s)
            if self.links:
                self.linked += len(s)

    def flush(self) -> None:
        if self.parts:
            text = _spaced("".join(self.parts))
            if text:
                n = self.stack[-1].block
                self.blocks.append((text, n))
                n.linked += self.linked
                n.text += len(text)
            self.parts.clear()
        self.linked = 0

    def close_to(self, i: int) -> None:
        if self.stack[-1].block is not self.stack[i - 1].block:
            self.flush()
        for n in self.stack[i:]:
            self.open[n.tag].pop()
            self.links -= n.tag == "a"
        del self.stack[i:]
        while self.scopes[-1] >= i:
            self.scopes.pop()

    def innermost(self, tags: set[str]) -> int:
        """Where the innermost open element of these names stands, unless a container is nearer; 0 if none."""
        i = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        return i if i >= self.scopes[-1] else 0

    def close(self, tag: str) -> None:
        places = self.open.get(tag)
        if places and (tag in SCOPE or places[-1] >= self.scopes[-1]):
            self.close_to(places[-1])

    def start(self, tag: str, attrs: str) -> bool:
        """Opens an element; whether what follows is not markup."""
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return False
        if tag == "body" and self.open.get("head"):
            self.close_to(self.open["head"][0])
        if tag == "html":
            return False
        if tag in ENDS_P and (i := self.innermost({"p"})):
            self.close_to(i)
        if tag in CLOSES and (i := self.innermost(CLOSES[tag])):
            self.close_to(i)
        if tag in BLOCK:
            self.flush()
        if tag in RAW:
            return True
        if attrs.endswith("/") and tag not in BLOCK:
            return False
        above = self.stack[-1]
        gone = above.gone or tag in DROPPED or bool(attrs) and tag not in ("body", "article", "main") and _furniture(attrs)
        node = Node(tag, above, gone)
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)
        self.links += tag == "a"
        return False


def main_text(html: str) -> str:
    tree = Tree(html)
    blocks = tree.blocks
    if not blocks:
        return ""
    for text, n in blocks:
        worth = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3) if len(text) >= 25 else 0.2
        up = (n.parent or n).block if n.tag in PARAGRAPH else n
        up.points += worth
        if up.parent is not None:
            up.parent.block.points += worth / 2
    for n in reversed(tree.nodes):  # children before parents
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.linked += n.linked

    def score(n: Node) -> float:
        bonus = 25.0 if n.tag in ("article", "main") else 0.0
        return (n.points + bonus) * (1 - min(1.0, n.linked / n.text))

    filled = [n for n in tree.nodes if n.text]
    top = best = max([n for n in filled if n.tag in BLOCK and n.tag not in NO_CONTAINER] or filled, key=score)
    n = best
    while n is not None:
        if n.tag in ("article", "main"):
            top = n
        n = n.parent
    top.kept = True
    if top.parent is not None and top.tag not in ("article", "main"):
        least = max(10.0, 0.2 * score(best))
        for n in filled:
            if n.parent is top.parent and (score(n) >= least or n.tag == "p" and n.text >= 80 and n.linked <= 0.25 * n.text):
                n.kept = True
    elif top.tag == "article" and top.parent is not None:  # one text may stand in several article elements side by side
        for n in filled:
            n.kept |= n.parent is top.parent and n.tag == "article"
    for n in tree.nodes:  # parents before children
        n.kept |= n.parent is not None and n.parent.kept
    return "\n\n".join(text for text, n in blocks if n.kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; null and empty html give an empty text.

    Repeated rows get a row each; broken markup is read as far as it goes; other columns play no part.
    """
    ship(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(work, "page_id long, url string, text string, n_chars long")
