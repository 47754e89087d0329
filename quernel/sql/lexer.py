"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError


class Token(NamedTuple):
    kind: str  # word, int, float, string, hex, op, end
    value: object
    at: int


_TOKEN = re.compile(
    r"(?P<space>\s+)"
    r"|(?P<hex>[xX]'[^']*')"
    r"|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<float>\d+\.\d+)"
    r"|(?P<int>\d+)"
    r"|(?P<string>'(?:[^']|'')*')"
    r"|(?P<op><>|!=|<=|>=|[=<>+\-*/%(),.;?])"
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "hex":
            digits = text[2:-1]
            try:
                out.append(Token("hex", bytes.fromhex(digits) if " " not in digits else None, at))
            except ValueError:
                raise ParseError(f"bad hexadecimal literal at {at}") from None
            if out[-1].value is None:
                raise ParseError(f"bad hexadecimal literal at {at}")
        elif kind == "string":
            out.append(Token("string", text[1:-1].replace("''", "'"), at))
        elif kind == "int":
            out.append(Token("int", int(text), at))
        elif kind == "float":
            out.append(Token("float", float(text), at))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", None, at))
    return out
