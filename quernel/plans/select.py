"""Queries as DataFrames.

Every table's columns are renamed to ``label.column`` when it is scanned, so names never clash in joins and each
reference is one flat name; Catalyst prunes and pushes down through the renaming.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import ExecutionError, SchemaError
from ..operators import fulltext
from ..sql.tree import AGGREGATES, Expr, OrderItem, Select, SetQuery, TableRef, has_aggregate, rewrite, walk
from .expressions import Compiled, Scope, column, compile_expr, kind_of, projected, truth


@dataclass
class Source:
    """A table that a query can read: rows, visible columns, key; full-text options by column."""

    rows: DataFrame
    visible: list[str]
    key: list[str]
    fulltext: dict[str, dict]
    normalised: Callable[[str], bool] = lambda _: False


class Planner:
    """Compiles queries against the tables that ``lookup`` finds."""

    def __init__(self, spark: SparkSession, lookup: Callable[[str], Source]):
        self.spark, self.lookup = spark, lookup

    def query(self, q: Select | SetQuery) -> DataFrame:
        return self.select(q) if isinstance(q, Select) else self.set_query(q)

    def set_query(self, q: SetQuery) -> DataFrame:
        out = self.select(q.first)
        names = out.columns
        for every, s in q.rest:
            df = self.select(s)
            if len(df.columns) != len(names):
                raise ExecutionError("UNION of different numbers of columns")
            out = out.union(df.toDF(*names))
            if not every:
                out = out.distinct()
        if q.order:
            scope = Scope({("", c): (column(c), kind_of(out.schema[c].dataType)) for c in names})
            item = lambda x: ("col", "", x[1]) if x[0] == "item" else None
            out = out.orderBy(*[_sorted(compile_expr(rewrite(_ordinal(o.expr, names), item), scope)[0], o) for o in q.order])
        return _cut(out, q.limit, q.offset)

    def _scan(self, ref: TableRef, scope: Scope) -> tuple[DataFrame, Source]:
        source = self.lookup(ref.name)
        if any(q == ref.label for q, _ in scope.columns):
            raise SchemaError(f"table label {ref.label} repeats")
        for f in source.rows.schema:
            scope.columns[ref.label, f.name] = (column(f"{ref.label}.{f.name}"), kind_of(f.dataType))
        return source.rows.select(*[F.col(column(c)).alias(f"{ref.label}.{c}") for c in source.rows.columns]), source

    def select(self, q: Select) -> DataFrame:
        scope = Scope(subquery=self.query)
        try:
            return self._select(q, scope)
        finally:
            for v in scope.views:
                self.spark.catalog.dropTempView(v)

    def _select(self, q: Select, scope: Scope) -> DataFrame:
        sources: dict[str, Source] = {}
        if q.table is None:
            df = self.spark.range(1).select(F.lit(1).alias("__row"))
        else:
            df, sources[q.table.label] = self._scan(q.table, scope)
        for j in q.joins:
            right, sources[j.table.label] = self._scan(j.table, scope)
            if j.kind == "cross":
                df = df.crossJoin(right)
            else:
                on, = self._searches([j.on], sources)
                df = df.join(right, F.expr(truth(compile_expr(on, scope))), j.kind)
        items = self._stars(q, sources)
        exprs = [e for e, _ in items]
        n = len(exprs)
        having = [q.having] if q.having is not None else []
        exprs = self._searches([*exprs, *([q.where] if q.where is not None else []), *having, *[o.expr for o in q.order], *q.group], sources)
        where = exprs[n] if q.where is not None else None
        rest = exprs[n + (q.where is not None) :]
        having, orders, group = rest[: len(having)], rest[len(having) : len(having) + len(q.order)], rest[len(having) + len(q.order) :]
        items = [(e, name) for e, (_, name) in zip(exprs[:n], items)]
        if where is not None:
            df = df.where(truth(compile_expr(where, scope)))
        names = _unique([name or _label(e) for e, name in items])
        key: list[str] = []
        if len(sources) == 1 and (s := next(iter(sources.values()))).key:
            label = next(iter(sources))
            key = [column(f"{label}.{k}") for k in s.key]
        orders = [_ordinal(e, names) for e in orders]
        # an alias stands for its item, in ORDER BY; a column of that name goes first only if no item is called so
        alias = {name: e for (e, given), name in zip(items, names) if given}
        orders = [alias.get(e[2], e) if e[0] == "col" and e[1] is None else e for e in orders]
        orders = [rewrite(e, lambda x: items[names.index(x[1])][0] if x[0] == "item" else None) for e in orders]
        if group or any(map(has_aggregate, [e for e, _ in items] + having + orders)):
            df, scope, back = self._aggregate(df, scope, group, [*[e for e, _ in items], *having, *orders], key)
            items = [(back(e), name) for e, name in items]
            having, orders, key = [back(e) for e in having], [back(e) for e in orders], []
        for h in having:
            df = df.where(truth(compile_expr(h, scope)))
        scope.shows_null = True
        out = [F.expr(projected(compile_expr(e, scope))).alias(name) for (e, _), name in zip(items, names)]
        scope.shows_null = False
        sort = [compile_expr(e, scope)[0] for e in orders]
        if q.distinct:
            texts = {compile_expr(e, scope)[0]: name for (e, _), name in zip(items, names)}
            hidden = {t: f"__s{i}" for i, t in enumerate(sort) if t not in texts}
            keys = [_sorted(column(texts[t]) if t in texts else hidden[t], o) for t, o in zip(sort, q.order)]
            if hidden:
                # a row that is left goes where the first of those that it stands for goes; Spark takes each task's firsts before it shuffles
                df = df.select(*out, *[F.expr(t).alias(h) for t, h in hidden.items()])
                first = F.row_number().over(Window.partitionBy(*[column(n) for n in names]).orderBy(*keys))
                df = df.withColumn("__first", first).where("__first = 1").orderBy(*keys)
                return _cut(df, q.limit, q.offset).select(*[column(c) for c in names])
            df = df.select(*out).distinct()
            if keys:
                df = df.orderBy(*keys)
        elif sort or (q.limit is not None or q.offset is not None) and key:
            # ties, and rows that a LIMIT takes without ORDER BY, go by key
            hidden = [(f"__s{i}", t, o) for i, (t, o) in enumerate([*zip(sort, q.order), *[(k, OrderItem(())) for k in key]])]
            df = df.select(*out, *[F.expr(t).alias(h) for h, t, _ in hidden]).orderBy(*[_sorted(h, o) for h, _, o in hidden])
            return _cut(df, q.limit, q.offset).select(*[column(c) for c in names])
        else:
            df = df.select(*out)
        return _cut(df, q.limit, q.offset)

    def _stars(self, q: Select, sources: dict[str, Source]) -> list[tuple[Expr, str | None]]:
        out: list[tuple[Expr, str | None]] = []
        for e, name in q.items:
            if e[0] != "star":
                out.append((e, name))
                continue
            labels = list(sources) if len(e) == 1 else [e[1]]
            for label in labels:
                if label not in sources:
                    raise SchemaError(f"unknown table {label}")
                out += [(("col", label, c), None) for c in sources[label].visible]
        return out

    def _aggregate(self, df: DataFrame, scope: Scope, group: list[Expr], used: list[Expr], key: list[str]):
        """Group; returns rows, their scope, and how expressions read them."""
        made = {e: f"__g{i}" for i, e in reversed([*enumerate(group)])}
        after = Scope(subquery=scope.subquery, views=scope.views)
        keys = []
        for e, name in made.items():
            compiled = compile_expr(e, scope)
            after.columns["", name] = (name, compiled[1])
            keys.append(F.expr(projected(compiled)).alias(name))
        parts = []
        by_text = {compile_expr(e, scope)[0]: name for e, name in made.items()}

        def back(e: Expr) -> Expr | None:
            """Group keys and aggregates become columns; other columns the group's first row's by key."""
            if e[0] == "col" and e not in made and (name := by_text.get(compile_expr(e, scope)[0])):
                return ("col", "", name)
            if e in made:
                return ("col", "", made[e])
            if not (e[0] == "func" and e[1] in AGGREGATES) and e[0] != "col":
                return None
            name = f"__a{len(parts)}"
            if e[0] == "col":
                text, kind = compile_expr(e, scope)
                order = f"struct({', '.join(key)})" if key else text
                text = f"min_by({text}, {order})"
            else:
                text, kind = compile_expr(e, scope)
            parts.append(F.expr(text).alias(name))
            after.columns["", name] = (name, kind)
            made[e] = name
            return ("col", "", name)

        changed = {id(e): rewrite(e, back) for e in used}
        lookup = {e: changed[id(e)] for e in used}
        grouped = df.groupBy(*keys)
        df = grouped.agg(*parts) if parts else grouped.agg(F.count(F.lit(1)).alias("__n"))
        return df, after, lambda e: lookup[e]

    def searches(self, exprs: list[Expr], name: str) -> list[Expr]:
        """The same for a statement that changes one table, whose columns go by their bare names."""
        if not any(x[0] in ("match", "snippet") for e in exprs for x in walk(e)):
            return exprs
        return self._searches(exprs, {name: self.lookup(name)}, lambda _, c: c)

    def _searches(self, exprs: list[Expr], sources: dict[str, Source], place: Callable[[str, str], str] = lambda label, c: f"{label}.{c}") -> list[Expr]:
        """MATCH and fts_snippet become expressions over their column; corpus numbers are gathered here, once."""
        nodes = {x for e in exprs for x in walk(e) if x[0] in ("match", "snippet")}
        made: dict[Expr, Expr] = {}
        for x in nodes:
            hits = [(label, s) for label, s in sources.items() if x[1] in s.fulltext]
            if len(hits) != 1:
                raise SchemaError(f"column {x[1]} has no full-text index here")
            label, s = hits[0]
            ready = s.normalised(x[1])
            here = column(place(label, x[1]))
            text = here if ready else f"quernel_nfkc({here})"
            if x[0] == "snippet":
                made[x] = ("raw", fulltext.snippet(text, *x[2:]), "str")
            elif x[3] == "boolean":
                made[x] = ("raw", fulltext.boolean(text, x[2]), "int")
            else:
                options = s.fulltext[x[1]]
                own = column(x[1]) if ready else f"quernel_nfkc({column(x[1])})"
                c = fulltext.corpus(s.rows, own, list(dict.fromkeys(fulltext.bigrams(x[2]))))
                made[x] = ("raw", fulltext.natural(text, x[2], c, options["stop_df_ratio_ppm"] if options["stop_filter"] else None), "int")
        return [rewrite(e, made.get) for e in exprs]


def _sorted(text: str, o: OrderItem):
    e = F.expr(text)
    return e.desc_nulls_last() if o.descending else e.asc_nulls_first()


def _ordinal(e: Expr, names: list[str]) -> Expr:
    if e[0] == "lit" and e[1] == "int":
        if not 1 <= e[2] <= len(names):
            raise ExecutionError(f"ORDER BY {e[2]}: there are {len(names)} columns")
        return ("item", names[e[2] - 1])
    return e


def _cut(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def _label(e: Expr) -> str:
    if e[0] == "col":
        return e[2]
    if e[0] == "func" and e[1] in AGGREGATES:
        arg = e[2][0] if e[2] else ("star",)
        return f"{e[1]}({'*' if arg == ('star',) else arg[2] if arg[0] == 'col' else '...'})"
    return "?column?"


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


__all__ = ["Compiled", "Planner", "Source"]
