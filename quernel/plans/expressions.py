"""Expressions of the dialect as Spark SQL text with a kind.

Integers are 64-bit; a boolean is 0 or 1 wherever it is a value; values of kinds that can't be compared are unequal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

from ..errors import ExecutionError, ParseError, SchemaError
from ..functions.scalar import NUMERIC, TEMPORAL, Compiled, arithmetic, call, cast, number, quote, text_of, truth, unify
from ..sql.tree import AGGREGATES, Expr


def kind_of(t: T.DataType) -> str:
    """The kind of a Spark type."""
    for kinds, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "float"), (T.DecimalType, "dec"), (T.BooleanType, "bool"),
        (T.BinaryType, "bin"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "dt"), (T.NullType, "null"),
    ):
        if isinstance(t, kinds):
            return name
    return "str"


def column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    """The names that an expression may use.

    columns: (qualifier, name) -> compiled.  subquery: compiles a nested query to a DataFrame.
    """

    columns: dict[tuple[str, str], Compiled] = field(default_factory=dict)
    subquery: object = None
    views: list[str] = field(default_factory=list)
    #: whether IN (SELECT ..) is a value here, so that its NULL shows; in a filter NULL and false are alike, and a semi join does
    shows_null: bool = False

    def find(self, qualifier: str | None, name: str) -> Compiled:
        if qualifier is not None:
            if (qualifier, name) in self.columns:
                return self.columns[qualifier, name]
            raise SchemaError(f"unknown column {qualifier}.{name}")
        hits = [v for (_, n), v in self.columns.items() if n == name]
        if len(hits) != 1:
            raise SchemaError(f"{'ambiguous' if hits else 'unknown'} column {name}")
        return hits[0]

    def view(self, query) -> tuple[str, DataFrame]:
        """A name under which a subquery's rows can be read in SQL text, and the rows."""
        if self.subquery is None:
            raise ExecutionError("a subquery can't stand here")
        df: DataFrame = self.subquery(query)
        import uuid

        name = f"quernel_sub_{uuid.uuid4().hex}"
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name, df


_FAMILY = {**{k: "number" for k in NUMERIC}, "str": "text", "bin": "binary", "date": "time", "dt": "time"}


def _comparable(a: Compiled, b: Compiled) -> tuple[str, str] | None:
    """Both sides as texts that Spark compares as the dialect does; None if they can't be compared."""
    (x, i), (y, j) = a, b
    if "null" in (i, j):
        return x, y
    if _FAMILY[i] == _FAMILY[j]:
        if _FAMILY[i] == "number":
            return (number(a)[0] if i == "bool" else x), (number(b)[0] if j == "bool" else y)
        return x, y
    if {_FAMILY[i], _FAMILY[j]} == {"time", "text"}:
        return tuple(f"TRY_CAST({t} AS TIMESTAMP_NTZ)" if _FAMILY[k] == "text" else f"CAST({t} AS TIMESTAMP_NTZ)" if k == "date" else t for t, k in (a, b))
    return None


def compare(op: str, a: Compiled, b: Compiled) -> str:
    sides = _comparable(a, b)
    if sides is None:
        return f"CASE WHEN {a[0]} IS NOT NULL AND {b[0]} IS NOT NULL THEN {'true' if op == '<>' else 'false'} END"
    if "null" in (a[1], b[1]):
        return "CAST(NULL AS BOOLEAN)"
    return f"({sides[0]} {op} {sides[1]})"


def literal(kind: str, value) -> Compiled:
    if kind == "int":
        if not -(1 << 63) <= value < 1 << 63:
            raise ParseError(f"integer {value} is too large")
        return (f"{value}L" if value >= 0 else f"({value}L)" if value > -(1 << 63) else "(-9223372036854775807L - 1L)"), "int"
    if kind == "float":
        return f"CAST('{value!r}' AS DOUBLE)", "float"
    if kind == "str":
        return quote(value), "str"
    if kind == "bin":
        return f"X'{value.hex()}'", "bin"
    if kind == "dec":
        return f"{value}BD", "dec"
    if kind == "date":
        return f"DATE'{value}'", "date"
    if kind == "dt":
        return f"TIMESTAMP_NTZ'{value}'", "dt"
    return "NULL", "null"


def _plain(e: Expr) -> bool:
    return e[0] == "lit" and e[1] != "null"


def compile_expr(e: Expr, scope: Scope) -> Compiled:
    """(Spark SQL text, kind) of an expression."""
    node = e[0]
    sub = lambda x: compile_expr(x, scope)
    if node == "lit":
        return literal(e[1], e[2])
    if node == "col":
        return scope.find(e[1], e[2])
    if node == "raw":
        return e[1], e[2]
    if node == "default":
        return "NULL", "null"
    if node == "param":
        raise ExecutionError("a parameter has no value")
    if node == "neg":
        t, k = number(sub(e[1]))
        return f"(- {t})", k
    if node == "not":
        return f"(NOT {truth(sub(e[1]))})", "bool"
    if node == "bin":
        op = e[1]
        a, b = sub(e[2]), sub(e[3])
        if op in ("AND", "OR"):
            return f"({truth(a)} {op} {truth(b)})", "bool"
        return (arithmetic(op, a, b)) if op in ("+", "-", "*", "/", "%") else (compare(op, a, b), "bool")
    if node == "like":
        a, p = sub(e[1]), sub(e[2])
        if a[1] not in ("str", "null") or p[1] not in ("str", "null"):
            return f"CASE WHEN {a[0]} IS NOT NULL AND {p[0]} IS NOT NULL THEN false END", "bool"
        pattern = quote(e[2][2].replace("\\", "\\\\")) if _plain(e[2]) else f"replace({p[0]}, '\\\\', '\\\\\\\\')"
        return f"({a[0]} {'NOT ' if e[3] else ''}LIKE {pattern})", "bool"
    if node == "regexp":
        return f"({text_of(sub(e[1]))} RLIKE {text_of(sub(e[2]))})", "bool"
    if node == "in":
        a = sub(e[1])
        items = [sub(x) for x in e[2]]
        fit = [(x, s) for x in items if (s := _comparable(a, x)) is not None]
        if not fit:
            return f"CASE WHEN {a[0]} IS NOT NULL THEN {'true' if e[3] else 'false'} END", "bool"
        if len({s[0] for _, s in fit}) == 1 and a[1] != "null":
            return f"({fit[0][1][0]} {'NOT ' if e[3] else ''}IN ({', '.join(s[1] for _, s in fit)}))", "bool"
        any_of = " OR ".join(compare("=", a, x) for x, _ in fit)
        return f"({'NOT ' if e[3] else ''}({any_of}))", "bool"
    if node == "between":
        a, lo, hi = sub(e[1]), sub(e[2]), sub(e[3])
        text = f"({compare('>=', a, lo)} AND {compare('<=', a, hi)})"
        if not (_plain(e[2]) and _plain(e[3])):
            text = f"CASE WHEN {a[0]} IS NOT NULL AND {lo[0]} IS NOT NULL AND {hi[0]} IS NOT NULL THEN {text} END"
        return (f"(NOT {text})" if e[4] else text), "bool"
    if node == "isnull":
        return f"({sub(e[1])[0]} IS {'NOT ' if e[2] else ''}NULL)", "bool"
    if node == "case":
        whens = [(compare("=", sub(e[1]), sub(w)) if e[1] is not None else truth(sub(w)), sub(t)) for w, t in e[2]]
        texts, kind = unify([t for _, t in whens] + [sub(e[3])])
        return "CASE " + " ".join(f"WHEN {w} THEN {t}" for (w, _), t in zip(whens, texts)) + f" ELSE {texts[-1]} END", kind
    if node == "cast":
        return cast(sub(e[1]), e[2].name, e[2].a, e[2].b)
    if node == "sub":
        name, df = scope.view(e[1])
        if len(df.columns) != 1:
            raise ExecutionError("a scalar subquery has one column")
        return f"(SELECT c0 FROM {name})", kind_of(df.schema[0].dataType)
    if node == "exists":
        name, _ = scope.view(e[1])
        return f"((SELECT count(*) FROM (SELECT * FROM {name} LIMIT 1)) {'=' if e[2] else '>'} 0)", "bool"
    if node == "insub":
        a = sub(e[1])
        name, df = scope.view(e[2])
        if len(df.columns) != 1:
            raise ExecutionError("an IN subquery has one column")
        sides = _comparable(a, ("c0", kind_of(df.schema[0].dataType)))
        if sides is None:
            return f"CASE WHEN {a[0]} IS NOT NULL THEN {'true' if e[3] else 'false'} END", "bool"
        if scope.shows_null:
            some, null = f"(SELECT count(*) FROM (SELECT * FROM {name} LIMIT 1)) > 0", f"(SELECT count(*) FROM (SELECT * FROM {name} WHERE c0 IS NULL LIMIT 1)) > 0"
            hit = f"CASE WHEN {a[0]} IS NULL AND {some} THEN NULL WHEN {sides[0]} IN (SELECT {sides[1]} FROM {name}) THEN true WHEN {null} THEN NULL ELSE false END"
            return (f"(NOT {hit})" if e[3] else hit), "bool"
        return f"({sides[0]} {'NOT ' if e[3] else ''}IN (SELECT {sides[1]} FROM {name}))", "bool"
    if node == "func":
        return _function(e, scope)
    if node in ("match", "snippet"):
        raise ExecutionError("MATCH and fts_snippet need a full-text index on the column")
    raise ExecutionError(f"unexpected {node}")


def _function(e: Expr, scope: Scope) -> Compiled:
    _, name, args, distinct = e
    if name in AGGREGATES:
        return aggregate(name, args, distinct, scope)
    if name == "IF":
        if len(args) != 3:
            raise ParseError("IF takes 3 arguments")
        return compile_expr(("case", None, ((args[0], args[1]),), args[2]), scope)
    if name == "NULLIF":
        if len(args) != 2:
            raise ParseError("NULLIF takes 2 arguments")
        a, b = (compile_expr(x, scope) for x in args)
        return f"CASE WHEN coalesce({compare('=', a, b)}, false) THEN NULL ELSE {a[0]} END", a[1]
    return call(name, [compile_expr(x, scope) for x in args])


def aggregate(name: str, args: tuple, distinct: bool, scope: Scope) -> Compiled:
    if len(args) != 1:
        raise ParseError(f"{name} takes one argument")
    if args[0] == ("star",):
        return "count(1)", "int"
    t, k = compile_expr(args[0], scope)
    d = "DISTINCT " if distinct else ""
    if name == "COUNT":
        return f"count({d}{t})", "int"
    if name in ("MIN", "MAX"):
        return (f"{name.lower()}({t})", k) if k != "bool" else (f"{name.lower()}(CAST({t} AS BIGINT))", "int")
    if k not in NUMERIC and k != "null":
        return "CAST(NULL AS BIGINT)", "int"
    t, k = number((t, k))
    if name == "SUM":
        return f"sum({d}{t})", k
    if k == "int":
        return f"(sum({d}{t}) div count({d}{t}))", "int"
    return f"avg({d}{t})", k


def projected(e: Compiled) -> str:
    """A value as it leaves a query: booleans are 0 and 1."""
    return f"CAST({e[0]} AS INT)" if e[1] == "bool" else e[0]


__all__ = ["TEMPORAL", "Compiled", "Scope", "aggregate", "column", "compare", "compile_expr", "kind_of", "literal", "number", "projected", "text_of", "truth"]
