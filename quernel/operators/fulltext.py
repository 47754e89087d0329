"""Bigram full-text search as column expressions.

A query's bigrams are few and known when the plan is built; corpus numbers (documents, bigrams, document
frequency of each of the query's bigrams) come from one aggregation over the text column.  Scores are then plain expressions,
inside whole-stage code: a scan, no shuffle, no Python (texts that aren't NFKC yet are normalised by an Arrow function).
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import quote

K1, B, SCALE = 1.2, 0.75, 1_000_000


def bigrams(text: str) -> list[str]:
    t = unicodedata.normalize("NFKC", text)
    return [t[i : i + 2] for i in range(len(t) - 1)]


def frequency(text: str, gram: str) -> str:
    """How often a bigram occurs; occurrences of aa overlap."""
    if gram[0] == gram[1]:
        escaped = "".join(f"\\x{{{ord(c):x}}}" for c in gram)
        return f"CAST(regexp_count({text}, {quote(f'(?={escaped})')}) AS BIGINT)"
    return f"CAST((octet_length({text}) - octet_length(replace({text}, {quote(gram)}, ''))) div {len(gram.encode())} AS BIGINT)"


def contains(text: str, part: str) -> str:
    return f"contains({text}, {quote(part)})"


@dataclass
class Corpus:
    """What scoring needs to know of an indexed column."""

    docs: int
    bigrams: int
    df: dict[str, int]


def corpus(table: DataFrame, text: str, grams: list[str]) -> Corpus:
    """One aggregation over the column; NULL texts aren't documents."""
    parts = [f"count({text}) AS n", f"coalesce(sum(greatest(char_length({text}) - 1, 0)), 0) AS t"]
    parts += [f"count_if({contains(text, g)}) AS d{i}" for i, g in enumerate(grams)]
    r = table.select(F.expr(text).alias("__text")).selectExpr(*[p.replace(text, "__text") for p in parts]).first()
    return Corpus(r["n"], r["t"], {g: r[f"d{i}"] for i, g in enumerate(grams)})


def natural(text: str, query: str, c: Corpus, stop_ppm: int | None) -> str:
    """BM25 over the query's distinct bigrams, times SCALE, rounded; 0 where none occurs.

    A document's length is the number of occurrences of the query's bigrams in it.
    """
    grams = [g for g in dict.fromkeys(bigrams(query)) if not (stop_ppm is not None and c.docs and c.df[g] * SCALE // c.docs >= stop_ppm)]
    grams = [g for g in grams if c.df[g]]
    if not grams or not c.docs:
        return "0L"
    average = max(c.bigrams / c.docs, 1.0)
    # the frequencies are fields of s, so that each is counted once a text
    fields = ", ".join(f"'f{i}', CAST({frequency(text, g)} AS DOUBLE)" for i, g in enumerate(grams))
    tf = [f"s.f{i}" for i in range(len(grams))]
    length = f"greatest({' + '.join(tf)}, 1D)"
    parts = []
    for g, f in zip(grams, tf):
        idf = math.log((c.docs - c.df[g] + 0.5) / (c.df[g] + 0.5) + 1.0)
        parts.append(f"CASE WHEN {f} > 0D THEN {idf!r}D * ({f} * {K1 + 1!r}D) / ({f} + {K1!r}D * ({1 - B!r}D + {B!r}D * {length} / {average!r}D)) ELSE 0D END")
    score = f"element_at(transform(array(named_struct({fields})), s -> {' + '.join(parts)}), 1)"
    return f"CAST(round(coalesce({score}, 0D) * {SCALE}D) AS BIGINT)"


def boolean_terms(query: str) -> list[tuple[str, str]]:
    """(must, not, should or phrase; term) of a boolean query."""
    out, i, q = [], 0, unicodedata.normalize("NFKC", query)
    while i < len(q):
        if q[i] == " ":
            i += 1
            continue
        sign = ""
        if q[i] in "+-":
            sign, i = q[i], i + 1
        if i < len(q) and q[i] == '"':
            end = q.find('"', i + 1)
            end = len(q) if end < 0 else end
            if term := q[i + 1 : end]:
                out.append(("phrase", term))
            i = end + 1
            continue
        end = q.find(" ", i)
        end = len(q) if end < 0 else end
        if term := q[i:end]:
            out.append(({"+": "must", "-": "not"}.get(sign, "should"), term))
        i = max(end, i + 1)
    return out


def boolean(text: str, query: str) -> str:
    """SCALE where the boolean query holds, else 0.  A term holds where any of its bigrams occurs."""

    def term(t: str) -> str:
        grams = dict.fromkeys(bigrams(t))
        return "(" + " OR ".join(contains(text, g) for g in grams) + ")" if grams else "false"

    terms = boolean_terms(query)
    wanted = [term(t) if k == "must" else contains(text, t) if len(t) > 1 else "false" for k, t in terms if k in ("must", "phrase")]
    if not wanted:
        some = [term(t) for k, t in terms if k == "should"]
        wanted = ["(" + " OR ".join(some) + ")"] if some else ["false"]
    wanted += [f"NOT {term(t)}" for k, t in terms if k == "not"]
    return f"CASE WHEN {' AND '.join(wanted)} THEN {SCALE}L ELSE 0L END"


def snippet(text: str, query: str, pre: str, post: str, n: int) -> str:
    """The first hit of the query in its surroundings of n characters; '' for NULL."""
    clean = unicodedata.normalize("NFKC", query).replace('"', "").lstrip("+-").strip()
    pre, post, n = quote(pre), quote(post), max(n, 0)
    size = f"char_length({text})"
    start = f"CASE WHEN {size} <= {2 * n} THEN {text} ELSE concat(left({text}, {2 * n}), '...') END"
    if not clean:
        return f"coalesce({start}, '')"

    def cut(place: str, length: str) -> str:
        lo, hi = f"greatest({place} - {n}, 1)", f"least({place} + {length} + {n} - 1, {size})"
        return (
            f"concat(CASE WHEN {lo} > 1 THEN '...' ELSE '' END, substring({text}, {lo}, {place} - {lo}), {pre}, substring({text}, {place}, {length}), {post}, "
            f"substring({text}, {place} + {length}, {hi} - ({place} + {length}) + 1), CASE WHEN {hi} < {size} THEN '...' ELSE '' END)"
        )

    whole = f"instr({text}, {quote(clean)})"
    out = f"WHEN {whole} > 0 THEN {cut(whole, str(len(clean)))}"
    if len(clean) >= 2:
        first = f"instr({text}, {quote(clean[:2])})"
        longest = " ".join(f"WHEN substring({text}, {first}, {k}) = {quote(clean[:k])} THEN {k}" for k in range(len(clean), 2, -1))
        length = f"(CASE {longest} ELSE 2 END)" if longest else "2"
        out += f" WHEN {first} > 0 THEN {cut(first, length)}"
    return f"CASE WHEN {text} IS NULL THEN '' {out} ELSE {start} END"


@lru_cache(maxsize=1)
def _suspects() -> tuple[str, str]:
    """Two Java patterns: of characters outside a few wide ranges that NFKC leaves alone, a quick test; and of all
    characters that NFKC may change, alone or by combining with what stands before them."""
    second, odd = set(), set()
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        pair = unicodedata.decomposition(chr(c)).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            second.add(int(pair[1], 16))
        if unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c):
            odd.add(c)
    points = sorted(odd | second | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})
    runs = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    gaps = [(a[1] + 1, b[0] - 1) for a, b in zip([[0, -1], *runs], [*runs, [0x110000, 0]]) if a[1] + 1 < b[0]]
    wide = [g for g in gaps if g[0] < 0x180 or g[1] - g[0] >= 1000]
    show = lambda ranges: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"[^{show(wide)}]", f"[{show(runs)}]"


def normalised(table: DataFrame, text: str) -> bool:
    """Whether no text has anything that NFKC might change, so that scoring can read the column as it is."""
    quick, exact = map(quote, _suspects())
    return table.where(F.expr(f"{text} RLIKE {quick} AND {text} RLIKE {exact}")).isEmpty()
