"""The scalar functions: name -> builder of Spark SQL text from compiled arguments.

A compiled expression is (text, kind), kind one of int, float, dec, bool, str, bin, date, dt, null.  Integers are 64-bit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import ExecutionError, ParseError

Compiled = tuple[str, str]
NUMERIC = ("int", "float", "dec", "bool")
TEXTUAL = ("str",)
TEMPORAL = ("date", "dt")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(e: Compiled) -> Compiled:
    """A numeric operand; booleans count as 0 and 1."""
    text, kind = e
    if kind in ("bool", "int"):
        return f"CAST({text} AS BIGINT)", "int"
    if kind == "null":
        return "CAST(NULL AS BIGINT)", "int"
    if kind in ("float", "dec"):
        return e
    raise ExecutionError(f"not a number: {text}")


def text_of(e: Compiled) -> str:
    """The value as it is displayed."""
    text, kind = e
    if kind == "str":
        return text
    if kind == "bool":
        return f"CAST(CAST({text} AS INT) AS STRING)"
    if kind == "float":
        return f"CASE WHEN {text} = floor({text}) AND abs({text}) < 1e18 THEN CAST(CAST({text} AS DECIMAL(38,0)) AS STRING) ELSE CAST({text} AS STRING) END"
    if kind == "dt":
        return f"date_format({text}, 'yyyy-MM-dd HH:mm:ss')"
    if kind == "bin":
        return f"decode({text}, 'UTF-8')"
    return f"CAST({text} AS STRING)"


def truth(e: Compiled) -> str:
    """Whether a value counts as true; NULL stays NULL."""
    text, kind = e
    if kind == "bool":
        return text
    if kind in ("int", "float", "dec"):
        return f"({text} <> 0)"
    if kind == "str":
        return f"({text} <> '')"
    if kind == "bin":
        return f"(octet_length({text}) > 0)"
    if kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    return f"CASE WHEN {text} IS NOT NULL THEN true END"


def unify(items: list[Compiled]) -> tuple[list[str], str]:
    """Branches of one kind: numbers widen, mixed kinds are shown as text."""
    kinds = {k for _, k in items} - {"null"}
    if not kinds:
        return [t for t, _ in items], "null"
    if len(kinds) == 1 and kinds != {"bool"}:
        return [t for t, _ in items], kinds.pop()
    if kinds <= {*NUMERIC}:
        kind = "float" if "float" in kinds else "dec" if "dec" in kinds else "int"
        return [number(e)[0] if e[1] != "null" else "NULL" for e in items], kind
    if kinds <= {*TEMPORAL}:
        return [f"CAST({t} AS TIMESTAMP_NTZ)" for t, _ in items], "dt"
    return [text_of(e) if e[1] != "null" else "NULL" for e in items], "str"


def moment(e: Compiled) -> str:
    """A temporal value, or a text in one of the exact forms, as TIMESTAMP_NTZ; else NULL."""
    text, kind = e
    if kind in TEMPORAL:
        return f"CAST({text} AS TIMESTAMP_NTZ)"
    if kind != "str":
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    return rf"CASE WHEN {text} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?$' THEN TRY_CAST({text} AS TIMESTAMP_NTZ) END"


_FORMATS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "T": "HH:mm:ss", "r": "hh:mm:ss a", "p": "a", "W": "EEEE", "a": "EEE",
}


def _date_format(value: Compiled, fmt: Compiled) -> Compiled:
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", fmt[0])
    if fmt[1] != "str" or not m:
        raise ExecutionError("DATE_FORMAT takes a literal format")
    pattern = re.sub(r"\\(.)", r"\1", m.group(1))
    at, parts, plain = moment(value), [], ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c != "%" or i == len(pattern):
            plain += c
            continue
        c = pattern[i]
        i += 1
        made = f"date_format({at}, '{_FORMATS[c]}')" if c in _FORMATS else {"w": f"CAST(dayofweek({at}) - 1 AS STRING)", "j": f"lpad(CAST(dayofyear({at}) AS STRING), 3, '0')", "f": "'000000'"}.get(c)
        if made is None:
            plain += c
        else:
            parts += ([quote(plain)] if plain else []) + [made]
            plain = ""
    parts += [quote(plain)] if plain or not parts else []
    return f"CASE WHEN {at} IS NOT NULL THEN concat({', '.join(parts)}) END", "str"


def _string(f: Callable[..., str]) -> Callable[..., Compiled]:
    """A function of texts and integers that gives a text; other kinds are displayed first."""
    return lambda *a: (f(*[text_of(x) if k == 0 or x[1] == "str" else x[0] for k, x in enumerate(a)]), "str")


def _int(e: Compiled) -> str:
    return f"CAST({number(e)[0]} AS INT)"


def _length(e: Compiled) -> Compiled:
    return (f"CAST(octet_length({e[0]}) AS BIGINT)" if e[1] in ("str", "bin") else "CAST(NULL AS BIGINT)"), "int"


def _chars(e: Compiled) -> Compiled:
    return (f"CAST(char_length({e[0]}) AS BIGINT)" if e[1] == "str" else "CAST(NULL AS BIGINT)"), "int"


def _substring(s: Compiled, pos: Compiled, n: Compiled | None = None) -> Compiled:
    t, p = text_of(s), _int(pos)
    size = f"greatest({_int(n)}, 0)" if n else f"char_length({t})"
    null = f" OR {n[0]} IS NULL" if n else ""
    return f"CASE WHEN {t} IS NULL OR {p} IS NULL{null} THEN NULL WHEN {p} = 0 THEN '' WHEN {p} < 0 AND -{p} > char_length({t}) THEN substring({t}, 1, {size}) ELSE substring({t}, {p}, {size}) END", "str"


def _trim(sides: str) -> Callable[[Compiled], Compiled]:
    return lambda e: (f"regexp_replace({text_of(e)}, {quote(sides)}, '')", "str")


_BLANK = r"[\s\p{Z}\x{85}\x{0b}]+"


def _replace(s: Compiled, old: Compiled, new: Compiled) -> Compiled:
    t, f, r = text_of(s), text_of(old), text_of(new)
    # an empty search text stands before every character and at the end
    return f"CASE WHEN {f} = '' THEN concat({r}, regexp_replace({t}, '(?s)(.)', concat('$1', regexp_replace({r}, '([\\\\\\\\$])', '\\\\\\\\$1')))) ELSE replace({t}, {f}, {r}) END", "str"


def _pad(side: str) -> Callable[..., Compiled]:
    def make(s: Compiled, n: Compiled, pad: Compiled) -> Compiled:
        t, p, size = text_of(s), text_of(pad), _int(n)
        return f"CASE WHEN {p} = '' AND char_length({t}) < {size} THEN {t} ELSE {side}({t}, greatest({size}, 0), {p}) END", "str"

    return make


def _locate(sub: Compiled, s: Compiled, pos: Compiled | None = None) -> Compiled:
    a, b = text_of(sub), text_of(s)
    if pos is None:
        return f"CAST(locate({a}, {b}) AS BIGINT)", "int"
    p = _int(pos)
    return f"CASE WHEN {p} < 1 OR {p} > char_length({b}) + 1 THEN 0L ELSE CAST(locate({a}, {b}, {p}) AS BIGINT) END", "int"


def _abs(e: Compiled) -> Compiled:
    t, k = number(e)
    return f"abs({t})", k


def _whole(f: str) -> Callable[[Compiled], Compiled]:
    def make(e: Compiled) -> Compiled:
        t, k = number(e)
        return (t if k == "int" else f"CAST({f}({t}) AS DOUBLE)" if k == "float" else f"{f}({t})"), k

    return make


def _round(e: Compiled, digits: Compiled | None = None) -> Compiled:
    t, k = number(e)
    d = _int(digits) if digits else "0"
    if k == "int":
        return t, k
    if k == "dec":
        m = re.fullmatch(r"CAST\(CAST\((-?\d+)L AS BIGINT\) AS INT\)|(0)", d)
        if not m:
            raise ExecutionError("ROUND of a decimal takes literal digits")
        n = int(m.group(1) or 0)
        return (t if n < 0 else f"bround({t}, {n})"), k
    scale = f"power(10D, {d})"
    # half away from zero
    return f"(CASE WHEN {t} < 0 THEN ceil({t} * {scale} - 0.5D) ELSE floor({t} * {scale} + 0.5D) END / {scale})", k


def arithmetic(op: str, a: Compiled, b: Compiled) -> Compiled:
    (x, i), (y, j) = number(a), number(b)
    if i == j == "int":
        return (f"({x} div {y})" if op == "/" else f"({x} {op} {y})"), "int"
    if "float" in (i, j):
        x, y = (f"CAST({t} AS DOUBLE)" if k != "float" else t for t, k in ((x, i), (y, j)))
        return f"({x} {op} {y})", "float"
    x, y = (f"CAST({t} AS DECIMAL(20,0))" if k == "int" else t for t, k in ((x, i), (y, j)))
    return f"({x} {op} {y})", "dec"


def _power(a: Compiled, b: Compiled) -> Compiled:
    (x, i), (y, j) = number(a), number(b)
    if i == j == "int":
        return f"CASE WHEN {y} < 0 AND {x} IS NOT NULL THEN 0L ELSE CAST(power({x}, {y}) AS BIGINT) END", "int"
    return f"power(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))", "float"


def _coalesce(*items: Compiled) -> Compiled:
    texts, kind = unify(list(items))
    return f"coalesce({', '.join(texts)})", kind


def _uuid7() -> Compiled:
    time = "lpad(hex(unix_millis(current_timestamp())), 12, '0')"
    r = "replace(uuid(), '-', '')"
    h = f"lower(concat({time}, '7', substring({r}, 14, 3), substring('89ab', CAST(floor(rand() * 4) AS INT) + 1, 1), substring({r}, 18, 15)))"
    return f"regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')", "str"


_SIMPLE_PATH = re.compile(r"'\$(?:\.[A-Za-z_]\w*|\[\d+\])*'")


def _json_extract(j: Compiled, path: Compiled) -> Compiled:
    if _SIMPLE_PATH.fullmatch(path[0]):
        return f"to_json(try_variant_get(parse_json({text_of(j)}), {path[0]}, 'variant'))", "str"
    return f"quernel_json_extract({text_of(j)}, {text_of(path)})", "str"


def _json_type(j: Compiled) -> Compiled:
    s = f"schema_of_variant(parse_json({text_of(j)}))"
    return f"CASE WHEN {s} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {s} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {s} = 'VOID' THEN 'NULL' WHEN {s} = 'BOOLEAN' THEN 'BOOLEAN' WHEN {s} = 'BIGINT' THEN 'INTEGER' WHEN {s} = 'STRING' THEN 'STRING' WHEN {s} LIKE 'DECIMAL(%,0)' THEN 'INTEGER' WHEN {s} IS NOT NULL THEN 'DOUBLE' END", "str"


#: name -> (least and most arguments, builder)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Compiled]]] = {
    "LENGTH": (1, 1, _length),
    "CHAR_LENGTH": (1, 1, _chars),
    "CHARACTER_LENGTH": (1, 1, _chars),
    "CONCAT": (1, 99, lambda *a: (f"concat({', '.join(text_of(x) for x in a)})", "str")),
    "SUBSTRING": (2, 3, _substring),
    "SUBSTR": (2, 3, _substring),
    "UPPER": (1, 1, _string(lambda s: f"upper({s})")),
    "LOWER": (1, 1, _string(lambda s: f"lower({s})")),
    "TRIM": (1, 1, _trim(f"^{_BLANK}|{_BLANK}$")),
    "LTRIM": (1, 1, _trim(f"^{_BLANK}")),
    "RTRIM": (1, 1, _trim(f"{_BLANK}$")),
    "REPLACE": (3, 3, _replace),
    "REVERSE": (1, 1, _string(lambda s: f"reverse({s})")),
    "REPEAT": (2, 2, lambda s, n: (f"repeat({text_of(s)}, greatest({_int(n)}, 0))", "str")),
    "LEFT": (2, 2, lambda s, n: (f"left({text_of(s)}, {_int(n)})", "str")),
    "RIGHT": (2, 2, lambda s, n: (f"right({text_of(s)}, {_int(n)})", "str")),
    "LPAD": (3, 3, _pad("lpad")),
    "RPAD": (3, 3, _pad("rpad")),
    "INSTR": (2, 2, lambda s, sub: (f"CAST(instr({text_of(s)}, {text_of(sub)}) AS BIGINT)", "int")),
    "LOCATE": (2, 3, _locate),
    "ABS": (1, 1, _abs),
    "CEIL": (1, 1, _whole("ceil")),
    "CEILING": (1, 1, _whole("ceil")),
    "FLOOR": (1, 1, _whole("floor")),
    "ROUND": (1, 2, _round),
    "MOD": (2, 2, lambda a, b: arithmetic("%", a, b)),
    "POWER": (2, 2, _power),
    "POW": (2, 2, _power),
    "NOW": (0, 0, lambda: ("CAST(date_trunc('SECOND', current_timestamp()) AS TIMESTAMP_NTZ)", "dt")),
    "CURRENT_TIMESTAMP": (0, 0, lambda: ("CAST(date_trunc('SECOND', current_timestamp()) AS TIMESTAMP_NTZ)", "dt")),
    "DATE_FORMAT": (2, 2, _date_format),
    "COALESCE": (1, 99, _coalesce),
    "IFNULL": (2, 2, _coalesce),
    "UUID_V4": (0, 0, lambda: ("uuid()", "str")),
    "UUID_V7": (0, 0, _uuid7),
    "JSON_EXTRACT": (2, 2, _json_extract),
    "JSON_SET": (3, 3, lambda j, p, v: (f"quernel_json_set({text_of(j)}, {text_of(p)}, {text_of(v)})", "str")),
    "JSON_REMOVE": (2, 2, lambda j, p: (f"quernel_json_remove({text_of(j)}, {text_of(p)})", "str")),
    "JSON_TYPE": (1, 1, _json_type),
    "JSON_CONTAINS": (2, 2, lambda j, v: (f"quernel_json_contains({text_of(j)}, {text_of(v)})", "bool")),
    "REGEXP": (2, 2, lambda s, p: (f"({text_of(s)} RLIKE {text_of(p)})", "bool")),
    "REGEXP_LIKE": (2, 2, lambda s, p: (f"({text_of(s)} RLIKE {text_of(p)})", "bool")),
}


def call(name: str, args: list[Compiled]) -> Compiled:
    if name not in FUNCTIONS:
        raise ExecutionError(f"unknown function {name}")
    least, most, build = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise ParseError(f"{name} takes {least}{'' if least == most else f' to {most}'} arguments, not {len(args)}")
    return build(*args)


def cast(e: Compiled, kind: str, a: int | None, b: int | None) -> Compiled:
    """CAST: integers aren't narrowed, decimals round half-even, texts must have the exact form."""
    t, k = e
    if kind in ("TINYINT", "SMALLINT", "INT", "BIGINT", "BOOLEAN"):
        return (f"CAST(regexp_replace({t}, '^\\\\s+|\\\\s+$', '') AS BIGINT)" if k == "str" else f"CAST({t} AS BIGINT)"), "int"
    if kind in ("FLOAT", "DOUBLE"):
        return f"CAST({t} AS DOUBLE)", "float"
    if kind == "DECIMAL":
        if k == "bool":
            t = number(e)[0]
        return f"CAST(bround(CAST({t} AS DECIMAL(38,{max(10, b or 0)})), {b or 0}) AS DECIMAL({a},{b or 0}))" if k != "dec" else f"CAST(bround({t}, {b or 0}) AS DECIMAL({a},{b or 0}))", "dec"
    if kind == "DATE":
        if k == "str":
            return f"CASE WHEN {t} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN CAST({t} AS DATE) WHEN {t} IS NOT NULL THEN CAST(raise_error(concat('invalid DATE ', {t})) AS DATE) END", "date"
        return f"CAST({t} AS DATE)", "date"
    if kind in ("DATETIME", "TIMESTAMP"):
        if k == "str":
            zone = "(Z|[+-][0-9]{2}:[0-9]{2})" if kind == "TIMESTAMP" else "(!)"
            plain = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}"
            return f"CASE WHEN {t} RLIKE '{plain}$' THEN CAST({t} AS TIMESTAMP_NTZ) WHEN {t} RLIKE '{plain}{zone}$' THEN to_utc_timestamp(CAST({t} AS TIMESTAMP), current_timezone())::TIMESTAMP_NTZ WHEN {t} IS NOT NULL THEN CAST(raise_error(concat('invalid {kind} ', {t})) AS TIMESTAMP_NTZ) END", "dt"
        return f"CAST({t} AS TIMESTAMP_NTZ)", "dt"
    if kind == "VARBINARY":
        return (t if k == "bin" else f"CAST({text_of(e)} AS BINARY)"), "bin"
    if kind == "UUID":
        h = f"lower(replace({text_of(e)}, '-', ''))"
        return f"CASE WHEN {h} RLIKE '^[0-9a-f]{{32}}$' THEN regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5') WHEN {t} IS NOT NULL THEN raise_error(concat('invalid UUID ', {text_of(e)})) END", "str"
    if kind == "JSONB":
        return f"quernel_json({text_of(e)})", "str"
    return text_of(e), "str"
