"""Statement fingerprints, explanations and feature-file runs."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloom.cypher.ast import Edge, Node, Read, Union_
from graphloom.cypher.lexer import tokens
from graphloom.cypher.parser import parse
from graphloom.engine import Engine
from graphloom.errors import QueryError


def shape(text: str) -> str:
    """The statement with literals elided, lists of them as one, comments gone and space collapsed."""
    out: list[str] = []
    for t in tokens(text):
        if t.kind == "end":
            continue
        word = "?" if t.kind in ("int", "float", "string") else f"${t.text}" if t.kind == "param" else t.text
        if word == "?" and out[-2:] == ["?", ","]:
            out.pop()
            continue
        out.append(word)
    return " ".join(out)


def fingerprint(text: str) -> str:
    """FNV-1a of the shape: the same for statements that differ in literals only."""
    h = 0xCBF29CE484222325
    for b in shape(text).encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def explain(engine: Engine, text: str, params: dict | None = None, mode: str = "formatted") -> str:
    """Access of each pattern in written order, then Spark's plan."""
    s = parse(text, params, engine.limits.hops)
    lines = []
    for n, arm in enumerate(s.arms if isinstance(s, Union_) else [s] if isinstance(s, Read) else []):
        bound: set[str] = set()
        for g in arm.groups:
            for p in g.patterns:
                lines.append(f"arm {n} {'optional ' if g.optional else ''}{_access(p, bound)}")
                bound |= {p.var} if isinstance(p, Node) else {p.src.var, p.dst.var}
    df = engine.read(text, params)
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        df.explain(mode)
    return "\n".join([*lines, buffer.getvalue()])


def _access(p: Node | Edge, bound: set[str]) -> str:
    if isinstance(p, Node):
        how = "bound" if p.var in bound else "id seek" if p.id is not None else "property scan" if p.props else f"label scan {':'.join(p.labels)}"
        return f"({p.var}): {how}"
    ends = [n.var in bound or n.id is not None for n in (p.src, p.dst)]
    if p.hops:
        how = f"frontier loop of {p.hops[0]} to {p.hops[1]} hops"
    else:
        how = "expand into" if all(ends) else "expand out" if ends[0] else "expand in" if ends[1] else "property scan" if p.props else "type scan"
    return f"({p.src.var})-[:{p.type}]->({p.dst.var}): {how}"


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str  # passed, failed, skipped
    reason: str = ""


def run_features(engine: Engine, text: str) -> list[Outcome]:
    """Scenarios of a .feature text: `When executing query:`, then a table of the result, in order or in any order.

    Scenarios with a statement outside of the supported subset are skipped.
    """
    out = []
    for block in re.split(r"(?m)^\s*Scenario(?: Outline)?:", text)[1:]:
        name, _, body = block.partition("\n")
        query = re.search(r'executing (?:control )?query:\s*"""\s*(.*?)"""', body, re.S)
        table = [[c.strip() for c in line.strip().strip("|").split("|")] for line in body[query.end() if query else 0 :].splitlines() if line.strip().startswith("|")]
        if query is None or not table:
            out.append(Outcome(name.strip(), "skipped", "no query or no table"))
            continue
        try:
            df = engine.read(query[1].strip())
        except QueryError as e:
            out.append(Outcome(name.strip(), "skipped", str(e)))
            continue
        got = [[_cell(x) for x in row] for row in df.collect()]
        want = [[c for c in row] for row in table[1:]]
        if "in any order" in body:
            got, want = sorted(got), sorted(want)
        same = df.columns == table[0] and got == want
        out.append(Outcome(name.strip(), "passed" if same else "failed", "" if same else f"got {df.columns} {got}"))
    return out


def _cell(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return f"'{x}'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_cell, x)) + "]"
    return str(x)
