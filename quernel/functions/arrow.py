"""Arrow-batched functions: JSON editing and paths beyond variants, and NFKC.

They are registered by name in the session, so that compiled SQL text can call them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from ..errors import ExecutionError

_DOT = re.compile(r'\.\.|\.\*|\.([A-Za-z_$][\w$-]*)|\."([^"]*)"|^([A-Za-z_*][\w]*)')
_NAME = re.compile(r"\*|[\w$-]+")
_QUOTED = re.compile(r"""\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")\s*""", re.DOTALL)
_SLICE = re.compile(r"\s*(-?\d*)\s*:\s*(-?\d*)\s*(?::\s*(-?\d*)\s*)?")
_TERM = re.compile(r"""\s*(?:(\|\||&&|==|!=|<=|>=|<|>|!|\(|\))|(@(?:\.[\w$-]+|\[[^\]]*\])*)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))""")


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        raise ExecutionError(f"invalid JSON: {text[:80]!r}") from None


@lru_cache(4096)
def path_steps(path: str) -> tuple[tuple, ...]:
    """Steps of a path that begins with $: ("key", k), ("at", i), ("slice", from, to, step), ("some", steps), ("every",), ("deep",), ("filter", condition)."""
    if not path.startswith("$"):
        raise ExecutionError(f"a path begins with $: {path!r}")
    out: list[tuple] = []
    rest, at = path[1:], 0
    while at < len(rest):
        if rest[at] == "[":
            end = _closing(rest, at, path)
            out.append(_bracket(rest[at + 1 : end].strip(), path))
            at = end + 1
            continue
        m = _DOT.match(rest, at)
        if not m:
            raise ExecutionError(f"invalid path {path!r}")
        text, at = m.group(), m.end()
        if text == "..":
            out.append(("deep",))
            if at < len(rest) and rest[at] not in ".[":
                name = _NAME.match(rest, at)
                if not name:
                    raise ExecutionError(f"invalid path {path!r}")
                out.append(("every",) if name.group() == "*" else ("key", name.group()))
                at = name.end()
        elif text == ".*":
            out.append(("every",))
        else:
            out.append(("key", next(g for g in m.groups() if g is not None)))
    return tuple(out)


def _closing(text: str, at: int, path: str) -> int:
    """Where the bracket that opens at a place closes."""
    deep, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "[]":
            deep += 1 if c == "[" else -1
            if not deep:
                return i
        i += 1
    raise ExecutionError(f"invalid path {path!r}")


def _bracket(text: str, path: str) -> tuple:
    if text == "*":
        return ("every",)
    if text.startswith("?"):
        inner = text[1:].strip()
        return ("filter", _condition(inner[1:-1] if inner.startswith("(") and inner.endswith(")") else inner))
    steps, at = [], 0
    while True:
        if m := _QUOTED.match(text, at):
            steps.append(("key", re.sub(r"\\(.)", r"\1", m.group(1) if m.group(1) is not None else m.group(2))))
        elif m := _SLICE.match(text, at):
            a, b, c = (int(g) if g else None for g in m.groups())
            if c is not None and c < 1:
                raise ExecutionError(f"invalid path {path!r}")
            steps.append(("slice", a, b, c))
        elif m := re.compile(r"\s*(-?\d+)\s*").match(text, at):
            steps.append(("at", int(m.group(1))))
        else:
            raise ExecutionError(f"invalid path {path!r}")
        at = m.end()
        if at == len(text):
            return steps[0] if len(steps) == 1 else ("some", tuple(steps))
        if text[at] != ",":
            raise ExecutionError(f"invalid path {path!r}")
        at += 1


def _condition(text: str) -> tuple:
    """A filter as a tree: ("or", a, b), ("and", a, b), ("not", a), (comparison, a, b), ("there", path), ("path", steps), ("value", v)."""
    terms, at = [], 0
    while at < len(text.rstrip()):
        m = _TERM.match(text, at)
        if not m:
            raise ExecutionError(f"invalid filter {text!r}")
        terms.append(m)
        at = m.end()
    terms.reverse()
    sign = lambda: terms[-1].group(1) if terms else None

    def either() -> tuple:
        e = both()
        while sign() == "||":
            terms.pop()
            e = ("or", e, both())
        return e

    def both() -> tuple:
        e = one()
        while sign() == "&&":
            terms.pop()
            e = ("and", e, one())
        return e

    def one() -> tuple:
        if sign() == "!":
            terms.pop()
            return ("not", one())
        if sign() == "(":
            terms.pop()
            e = either()
            if sign() != ")":
                raise ExecutionError(f"invalid filter {text!r}")
            terms.pop()
            return e
        a = operand()
        if sign() in ("==", "!=", "<", "<=", ">", ">="):
            return (terms.pop().group(1), a, operand())
        return ("there", a)

    def operand() -> tuple:
        if not terms or terms[-1].group(1):
            raise ExecutionError(f"invalid filter {text!r}")
        m = terms.pop()
        if m.group(2):
            return ("path", path_steps("$" + m.group(2)[1:]))
        literal = m.group(3)
        return ("value", re.sub(r"\\(.)", r"\1", literal[1:-1]) if literal[0] == "'" else load(literal))

    e = either()
    if terms:
        raise ExecutionError(f"invalid filter {text!r}")
    return e


def _children(v) -> list:
    return list(v.values()) if isinstance(v, dict) else list(v) if isinstance(v, list) else []


_NONE = object()


def _holds(v, e: tuple) -> bool:
    if e[0] == "or":
        return _holds(v, e[1]) or _holds(v, e[2])
    if e[0] == "and":
        return _holds(v, e[1]) and _holds(v, e[2])
    if e[0] == "not":
        return not _holds(v, e[1])
    if e[0] == "there":
        return e[1][0] == "value" or bool(find(v, e[1][1]))
    sides = []
    for kind, x in e[1:]:
        if kind == "path":
            hits = find(v, x)
            x = hits[0] if hits else _NONE
        sides.append(x)
    a, b = sides
    if a is _NONE or b is _NONE:
        return False
    if e[0] in ("==", "!="):
        return (a == b and isinstance(a, bool) == isinstance(b, bool)) == (e[0] == "==")
    if isinstance(a, bool) or isinstance(b, bool) or not (isinstance(a, int | float) and isinstance(b, int | float) or isinstance(a, str) and isinstance(b, str)):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[0]]


def find(doc, steps: tuple[tuple, ...]) -> list:
    """All values that a path leads to, in document order."""
    now = [doc]
    for s in steps:
        if s[0] == "key":
            now = [v[s[1]] for v in now if isinstance(v, dict) and s[1] in v]
        elif s[0] == "at":
            now = [v[s[1]] for v in now if isinstance(v, list) and -len(v) <= s[1] < len(v)]
        elif s[0] == "slice":
            now = [c for v in now if isinstance(v, list) for c in v[s[1] : s[2] : s[3]]]
        elif s[0] == "some":
            now = [c for v in now for x in s[1] for c in find(v, (x,))]
        elif s[0] == "every":
            now = [c for v in now for c in _children(v)]
        elif s[0] == "filter":
            now = [c for v in now for c in (v if isinstance(v, list) else [v]) if _holds(c, s[1])]
        else:
            out, todo = [], list(reversed(now))
            while todo:
                v = todo.pop()
                out.append(v)
                todo += reversed(_children(v))
            now = out
    return now


def extract(text: str, path: str) -> str | None:
    hits = find(load(text), path_steps(path))
    return None if not hits else canonical(hits[0] if len(hits) == 1 else hits)


def _embed(value: str):
    try:
        return json.loads(value)
    except ValueError:
        return value


def _editable(path: str) -> tuple[tuple, ...]:
    steps = path_steps(path)
    if any(s[0] not in ("key", "at") or s[0] == "at" and s[1] < 0 for s in steps):
        raise ExecutionError(f"can't edit at {path!r}")
    return steps


def put(text: str, path: str, value: str) -> str:
    steps, new = _editable(path), _embed(value)
    root = [load(text)]
    holder, at = root, 0
    for s in steps:
        inner = holder[at]
        if s[0] == "key":
            if not isinstance(inner, dict):
                inner = holder[at] = {}
            inner.setdefault(s[1], None)
        else:
            if not isinstance(inner, list):
                inner = holder[at] = []
            inner.extend([None] * (s[1] + 1 - len(inner)))
        holder, at = inner, s[1]
    holder[at] = new
    return canonical(root[0])


def remove(text: str, path: str) -> str:
    steps, doc = _editable(path), load(text)
    if not steps:
        return "null"
    holders = find(doc, steps[:-1])
    kind, k = steps[-1]
    for h in holders:
        if kind == "key" and isinstance(h, dict):
            h.pop(k, None)
        elif kind == "at" and isinstance(h, list) and k < len(h):
            del h[k]
    return canonical(doc)


def _within(doc, want) -> bool:
    if doc == want and isinstance(doc, bool) == isinstance(want, bool):
        return True
    if isinstance(doc, dict) and isinstance(want, dict) and all(k in doc and _within(doc[k], v) for k, v in want.items()):
        return True
    if isinstance(doc, list) and isinstance(want, list) and all(any(_within(d, w) for d in doc) for w in want):
        return True
    return any(_within(c, want) for c in _children(doc))


def contains(text: str, value: str) -> bool:
    doc = load(text)
    return bool(find(doc, path_steps(value))) if value.startswith("$") else _within(doc, _embed(value))


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL text in this session."""
    if getattr(spark, "_quernel_functions", False):
        return
    spark._quernel_functions = True

    def add(name: str, result: str, f, n: int) -> None:
        kind = {"string": pa.string(), "boolean": pa.bool_()}[result]

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array([None if None in row else f(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

        spark.udf.register(name, _typed(run, n, result))

    for name, result, f, n in (
        ("quernel_json_extract", "string", extract, 2),
        ("quernel_json_set", "string", put, 3),
        ("quernel_json_remove", "string", remove, 2),
        ("quernel_json_contains", "boolean", contains, 2),
        ("quernel_json", "string", lambda t: canonical(load(t)), 1),
        ("quernel_nfkc", "string", nfkc, 1),
    ):
        add(name, result, f, n)


def _typed(run, n: int, result: str):
    if n == 1:

        def f1(a: pa.Array) -> pa.Array:
            return run(a)

        return arrow_udf(f1, result)
    if n == 2:

        def f2(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return arrow_udf(f2, result)

    def f3(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return arrow_udf(f3, result)
