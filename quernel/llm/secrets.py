"""Secret scans: base patterns, and assignment-aware lexing of source and configuration syntax.

Base kinds are ``assign`` (a sensitive name, ``:`` or ``=``, a literal of 6+ characters), ``access`` (``AKIA`` and 16+
more) and ``hex`` (24+ digits).  The lexer adds ``lexed`` spans: it parses name-literal pairs (``a = "x"``, ``a: x``, ``"a": "x"``,
``a => 'x'``, ``--a x``, ``<a>x</a>``, URL user information), propagates constants (names, concatenations, calls around a literal),
and scores each literal by the names that it reaches.  A literal is reported, by its own span, if its score is at
least ``THRESHOLD``, whether or not a base span holds it too.

No token spans lines, so lines are lexed one by one, and those without ``:``, ``=``, ``<`` and flags not at all; constants are propagated over the whole text.
Time and memory are linear in a text: a scheme begins at the beginning of a word, a quote after a backslash begins no string (so at most one string a line and kind of quote is
sought in vain), and a name within an unquoted value has the value up to the next ``:`` or ``=``.

Offsets are code points, ends exclusive.  Defined cases: null texts are empty; texts of any length are scanned whole; spans that begin together are in the order of kinds, then ends; a text
without ``:``, ``=``, ``AKIA``, ``<`` or a run of 24 hexadecimal digits can have no span and is not parsed.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import bounded_batches, buffers, lean, runs, slices

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: words of a target name, and how much each says
NAMES = {"password": 5, "passwd": 5, "pwd": 4, "pass": 3, "passphrase": 5, "secret": 5, "token": 4, "apikey": 5, "api_key": 5, "credential": 4, "credentials": 4, "auth": 2, "authorization": 4, "bearer": 3, "private_key": 5, "privatekey": 5, "access_key": 5, "accesskey": 5, "secret_key": 5, "client_secret": 6, "signing_key": 5, "encryption_key": 5, "session_key": 4, "dsn": 2, "connection_string": 3, "key": 1}
#: least score of a reported literal
THRESHOLD = 6.0
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\).|changeme|example|your[_-].*|none|null|true|false|undefined|todo|test|dummy|placeholder|redacted)$")

_TOKEN = re.compile(
    r"""(?P<string>(?<!\\)"(?:[^"\\\n]|\\.)*+"|(?<!\\)'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
    r"""|(?P<tag><(?P<t>[A-Za-z_][\w.-]*+)>(?P<inner>[^<>\n]++)</(?P=t)>)"""
    r"""|(?P<url>(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@"']++:(?P<pw>[^\s/@"']++)@)"""
    r"""|(?P<flag>--[A-Za-z][\w-]*)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:(?:[.-]|->)[A-Za-z_]\w*)*)"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<op>=>|:=|==|!=|<=|>=|\?=|\+=|[=:+,;(){}\[\]<>!|&])""",
    re.ASCII,
)
#: lines that may hold a pair, and what they are told by
_LINE, _TRIGGER = re.compile(r"[^\n]+"), re.compile(r"[:=<]|--[A-Za-z]")
#: what may lie between a flag and its value
_BLANKS = re.compile(r"[ \t]*")
#: an unquoted value: up to the end of the word, with equals signs only at that end; and up to the next sign
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>=]++(?:=++(?=[\s\"'`,;(){}\[\]<>]|\Z))?")
_SHORT = re.compile(r"[^\s\"'`,;(){}\[\]<>=:]+")
_ASSIGNS = frozenset(["=", ":", ":=", "=>", "?=", "+="])
#: kinds of tokens
STRING, TAG, URL, FLAG, NAME, NUMBER, OP = range(7)
_KIND = {"string": STRING, "tag": TAG, "t": TAG, "inner": TAG, "url": URL, "pw": URL, "flag": FLAG, "name": NAME, "number": NUMBER, "op": OP}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, sorted by start, then kind as listed."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _words(name: str) -> list[str]:
    """The words of snake_case, kebab-case, dotted and camelCase names, and neighbouring pairs of them."""
    own = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return own + [f"{a}_{b}" for a, b in zip(own, own[1:])] + ["".join(own)]


def name_score(name: str) -> int:
    return max((NAMES.get(w, 0) for w in _words(name)), default=0)


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, entropy; placeholders and prose don't."""
    if len(literal) < 6 or _PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return -10.0
    count = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in count.values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(len(literal), 32) / 16 + entropy / 2 + (classes - 1) * 0.75 - (1.5 if literal.isalpha() else 0)


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose sensitive target names score THRESHOLD or more."""
    pairs: list[tuple[str, list[tuple[int, int]], list[str]]] = []
    found: dict[tuple[int, int], float] = {}
    scores: dict[str, int] = {}

    def score_of(name: str) -> int:
        if name not in scores:
            scores[name] = name_score(name)
        return scores[name]

    def consider(score: int, span: tuple[int, int]) -> None:
        if score:
            found[span] = max(found.get(span, -99.0), score + literal_score(text[slice(*span)]))

    for line in _LINE.finditer(text):
        if not _TRIGGER.search(text, *line.span()):
            continue
        kinds, starts, ends = bytearray(), array("q"), array("q")
        for m in _TOKEN.finditer(text, *line.span()):
            kind = _KIND[m.lastgroup]
            if kind == TAG:
                consider(score_of(m.group("t")), m.span("inner"))
            elif kind == URL:
                consider(NAMES["password"], m.span("pw"))
            kinds.append(kind)
            starts.append(m.start())
            ends.append(m.end())
        _pairs(text, line.end(), kinds, starts, ends, pairs)
    # constants: a literal counts for the most sensitive name that its own name's value reaches
    sources: dict[str, set[str]] = {}
    for name, _, names in pairs:
        sources.setdefault(name, set()).update(names)
    reached: dict[str, int] = {}
    for first in sorted(sources, key=score_of, reverse=True):
        if not (score := score_of(first)):
            break
        todo = [first]
        while todo:
            if (name := todo.pop()) not in reached:
                reached[name] = score
                todo += sources.get(name, ())
    for name, literals, _ in pairs:
        for span in literals:
            consider(reached.get(name, 0), span)
    return [(a, b, "lexed") for (a, b), s in sorted(found.items()) if s >= THRESHOLD]


def _pairs(text: str, end: int, kinds: bytearray, starts: array, ends: array, pairs: list) -> None:
    """Adds the name-literal pairs of a line's tokens: (name, spans of literals, names in the value)."""
    n, bare_end = len(kinds), -1
    for k in range(n - 1):
        kind, then = kinds[k], kinds[k + 1]
        if kind == FLAG and then in (STRING, NAME, NUMBER) and (starts[k + 1] - ends[k] <= 2 or _BLANKS.fullmatch(text, ends[k], starts[k + 1])):
            if then == STRING:
                pairs.append((text[starts[k] + 2 : ends[k]], [(starts[k + 1] + 1, ends[k + 1] - 1)], []))
            elif b := _BARE.match(text, starts[k + 1], end):
                pairs.append((text[starts[k] + 2 : ends[k]], [b.span()], []))
        elif kind in (NAME, STRING, FLAG) and then == OP and text[starts[k + 1] : ends[k + 1]] in _ASSIGNS:
            literals, names, bare = _value(text, end, kinds, starts, ends, k + 1, _SHORT if starts[k] < bare_end else _BARE)
            bare_end = max(bare_end, bare)
            if literals or names:
                pairs.append((text[starts[k] : ends[k]].strip("\"'`-"), literals, names))


def _value(text: str, end: int, kinds: bytearray, starts: array, ends: array, k: int, word: re.Pattern) -> tuple[list[tuple[int, int]], list[str], int]:
    """Literals and names right of the sign k: strings and names joined by +, calls around them, or a bare word; and where that word ends."""
    literals: list[tuple[int, int]] = []
    names: list[str] = []
    deep, glue = 0, True
    for i in range(k + 1, len(kinds)):
        kind, own = kinds[i], text[starts[i] : ends[i]] if kinds[i] == OP else ""
        if own in (",", ";", "}", "]") and not deep:
            break
        if kind == STRING and glue:
            literals.append((starts[i] + 1, ends[i] - 1))
            glue = False
        elif kind == NAME and glue:
            names.append(text[starts[i] : ends[i]])
            glue = i + 1 < len(kinds) and kinds[i + 1] == OP and text[starts[i + 1]] == "("
        elif own in ("+", "(", ",", ".", "|"):
            deep += own == "("
            glue = True
        elif own == ")":
            deep -= 1
            if deep < 0:
                break
        else:
            break
    at = -1
    if not literals:
        bare = word.match(text, _BLANKS.match(text, ends[k], end).end(), end)
        if bare:
            at, value, known = bare.end(), bare.group(), bare.group() in names
            if not (known and value.isidentifier() and text[starts[k] : ends[k]] != "=") and (not known or any(c.isdigit() for c in value)):
                literals = [bare.span()]
    return literals, names, at


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each sorted by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + lexed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[0x30:0x3A] = _HEXDIGIT[0x61:0x67] = True
_SIGN = np.zeros(256, bool)
_SIGN[[0x3A, 0x3D, 0x3C]] = True
_FLAG = np.frombuffer(b"--", np.uint8)


def candidates(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: with one of : = <, two hyphens before a letter, AKIA, or a long hexadecimal run."""
    mark = _SIGN[raw]
    if len(raw) > 3:
        mark[:-3] |= (raw[:-3] == 0x41) & (raw[1:-2] == 0x4B) & (raw[2:-1] == 0x49) & (raw[3:] == 0x41)
        mark[:-2] |= (raw[:-2] == 0x2D) & (raw[1:-1] == 0x2D) & ((raw[2:] | 0x20) >= 0x61) & ((raw[2:] | 0x20) <= 0x7A)
    starts, ends = runs(_HEXDIGIT[raw], offsets)
    mark[starts[ends - starts >= 24]] = True
    return np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets]) > 0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed for each document; a scan without a shuffle."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            n = batch.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            digests, listed = [empty] * n, [""] * n
            for i, j in slices(offsets):
                a, b = int(offsets[i]), int(offsets[j])
                for r in np.flatnonzero(candidates(raw[a:b], offsets[i : j + 1] - a)) + i:
                    base, every = spans_of(bytes(raw[offsets[r] : offsets[r + 1]]).decode())
                    for s in every:
                        counts[s[2]][r] += 1
                    digests[r] = hashlib.sha256(",".join(f"{k}:{x}:{y}" for x, y, k in base).encode()).hexdigest()
                    listed[r] = ",".join(f"{k}:{x}:{y}" for x, y, k in every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[k]) for k in KINDS[:3]], pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(counts["lexed"])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    out = df.mapInArrow(lean(run), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
    return out.withColumnRenamed("id", id_col)
