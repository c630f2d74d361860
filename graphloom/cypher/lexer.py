"""Tokens of statement text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from graphloom.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`[^`]+`)
    |(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|<>|<-|->|\.\.|[-+*/%^=<>(){}\[\],.:;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # float, int, string, param, name, op, end
    text: str
    at: int
    quoted: bool = False


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] == "u" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        kind, body = m.lastgroup, m[0]
        if kind == "int" and text[m.end() : m.end() + 2] != ".." and re.match(r"\.\d", text[m.end() :]):
            raise ParseError(f"malformed number at {at}")
        if kind == "string":
            out.append(Token("string", _unescape(body[1:-1]), at))
        elif kind == "quoted":
            out.append(Token("name", body[1:-1], at, True))
        elif kind == "param":
            out.append(Token("param", body[1:], at))
        elif kind != "space":
            out.append(Token(kind, body, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
