"""INSERT, REPLACE, upserts, UPDATE and DELETE as new snapshots, with keys, checks and foreign keys.

The rows of a statement's VALUES are few and handled on the driver; whatever touches table rows is a DataFrame: semi and
anti joins on keys.  An insert only adds a folder to the snapshot; other changes rewrite the table's rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import CheckViolation, ExecutionError, ForeignKeyViolation, SchemaError, UniqueViolation
from ..functions.scalar import Compiled, cast, text_of
from ..plans.expressions import Scope, column, compile_expr, kind_of, truth
from ..sources.catalog import Catalog, Table, spark_type
from ..sources.storage import materialize
from ..sql.tree import Delete, ForeignKey, Insert, Type, Update

_RANGE = {"TINYINT": 1 << 7, "BOOLEAN": 1 << 7, "SMALLINT": 1 << 15, "INT": 1 << 31}


def coerced(e: Compiled, t: Type, name: str) -> str:
    """A value as a column of a type stores it; out of range is an error."""
    text, kind = e
    full = spark_type(t).simpleString().upper()
    if kind == "null":
        return f"CAST(NULL AS {full})"
    bad = lambda what: f"raise_error(concat('{what} for column {name}'))"
    if t.name in _RANGE or t.name == "BIGINT":
        if kind in ("date", "dt", "bin"):
            raise ExecutionError(f"column {name} takes integers")
        v = cast(e, "BIGINT", None, None)[0]
        if t.name == "BIGINT":
            return v
        n = _RANGE[t.name]
        return f"CASE WHEN {v} < -{n}L OR {v} >= {n}L THEN CAST({bad('out of range')} AS {full}) ELSE CAST({v} AS {full}) END"
    if t.name in ("FLOAT", "DOUBLE"):
        v = cast(e, "DOUBLE", None, None)[0]
        return f"CASE WHEN isnan(CAST({v} AS {full})) OR abs(CAST({v} AS {full})) = CAST('Infinity' AS {full}) THEN CAST({bad('not finite')} AS {full}) ELSE CAST({v} AS {full}) END"
    if t.name in ("DATE", "DATETIME", "TIMESTAMP") and kind not in ("str", "date", "dt"):
        raise ExecutionError(f"column {name} takes dates")
    if t.name in ("VARCHAR", "VARBINARY") and t.a is not None:
        v = (text if kind == "bin" else f"CAST({text_of(e)} AS BINARY)") if t.name == "VARBINARY" else text_of(e)
        size = "octet_length" if t.name == "VARBINARY" else "char_length"
        return f"CASE WHEN {size}({v}) > {t.a} THEN CAST({bad('too long')} AS {full}) ELSE {v} END"
    if t.name == "VARBINARY":
        if kind not in ("str", "bin"):
            raise ExecutionError(f"column {name} takes bytes")
    return cast(e, t.name, t.a, t.b)[0]


class Changes:
    """The changes of one statement to a catalog that is its own copy."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, subquery):
        self.spark, self.catalog, self.root, self.subquery = spark, catalog, root, subquery

    # storage

    def rows(self, table: Table) -> DataFrame:
        return table.rows(self.spark)

    def store(self, table: Table, df: DataFrame) -> None:
        """Make df the table's snapshot."""
        path = f"{self.root}/{table.name}/{uuid.uuid4().hex}"
        df.select(*[F.col(column(c.name)).cast(spark_type(c.type)) for c in table.columns]).write.parquet(path)
        table.parts, table.stored = [path], [c.name for c in table.columns]

    def append(self, table: Table, df: DataFrame) -> None:
        if table.stored != [c.name for c in table.columns]:
            self.store(table, self.rows(table))
        path = f"{self.root}/{table.name}/{uuid.uuid4().hex}"
        df.select(*[F.col(column(c.name)).cast(spark_type(c.type)) for c in table.columns]).coalesce(1).write.parquet(path)
        table.parts = [*table.parts, path]

    def scope(self, table: Table, df: DataFrame) -> Scope:
        own = {(table.name, f.name): (column(f.name), kind_of(f.dataType)) for f in df.schema}
        return Scope(own, subquery=self.subquery)

    def frame(self, table: Table, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, table.schema())

    # checks

    def check_rows(self, table: Table, df: DataFrame) -> None:
        """NOT NULL and CHECK of rows that are about to be written, in one job."""
        rules = [(f"{c.name} is NOT NULL", f"{column(c.name)} IS NULL") for c in table.columns if not c.nullable or c.name in table.primary and len(table.primary) == 1]
        for c in table.columns:
            if c.check:
                rules.append((f"CHECK ({c.check})", f"{column(c.name)} IS NOT NULL AND NOT coalesce({truth(compile_expr(c.check_expr, self.scope(table, df)))}, false)"))
        if rules:
            found = df.select(*[F.max(F.expr(f"coalesce({t}, false)")).alias(f"r{i}") for i, (_, t) in enumerate(rules)]).first()
            for (what, _), hit in zip(rules, found):
                if hit:
                    raise CheckViolation(f"table {table.name}: {what}")

    def check_unique(self, table: Table, df: DataFrame, keys: list[list[str]]) -> None:
        for key in keys:
            some = df.dropna(subset=key)
            if not some.groupBy(*key).count().where("count > 1").isEmpty():
                raise UniqueViolation(f"table {table.name}: ({', '.join(key)}) repeats")

    def check_parents(self, table: Table, df: DataFrame) -> None:
        """Every non-NULL reference of rows of the table finds a parent."""
        for fk in table.foreign:
            own = df.select(*fk.columns).dropna().distinct().toDF(*fk.parents)
            parent = self.catalog.table(fk.table)
            rows = self.rows(parent).select(*fk.parents)
            if parent.name == table.name:
                rows = rows.unionByName(df.select(*fk.parents))
            if not own.join(rows, fk.parents, "left_anti").isEmpty():
                raise ForeignKeyViolation(f"table {table.name}: ({', '.join(fk.columns)}) has no parent in {fk.table}")

    # INSERT, REPLACE, ON DUPLICATE KEY UPDATE

    def insert(self, q: Insert) -> int:
        table = self.catalog.table(q.table)
        writable(table)
        rows = self._values(table, q)
        if q.replace:
            return self._replace(table, rows)
        if q.on_duplicate:
            return self._upsert(table, rows, q.on_duplicate)
        df = self.frame(table, rows)
        self.check_rows(table, df)
        self._clash(table, rows, df)
        self.check_parents(table, df)
        self.append(table, df)
        return len(rows)

    def _values(self, table: Table, q: Insert) -> list[tuple]:
        """The statement's rows, with defaults, counters and coerced values."""
        if q.columns is not None:
            names = q.columns
            for n in names:
                table.column(n)
            if len(set(names)) < len(names):
                raise SchemaError("a column repeats")
        else:
            visible = [c for c in table.columns if not c.hidden]
            manual = [c.name for c in visible if not c.auto_increment]
            names = manual if q.rows and len(q.rows[0]) == len(manual) != len(visible) else [c.name for c in visible]
        selects = []
        for i, row in enumerate(q.rows):
            if len(row) != len(names):
                raise ExecutionError(f"{len(row)} values for {len(names)} columns")
            given = dict(zip(names, row))
            parts = [f"{i}L AS __i"]
            for c in table.columns:
                v = compile_expr(given.get(c.name, ("default",)), Scope(subquery=self.subquery))
                if c.default is not None:
                    d = coerced(compile_expr(c.default_expr, Scope()), c.type, c.name)
                    parts.append(f"coalesce({coerced(v, c.type, c.name)}, {d}) AS {column(c.name)}")
                else:
                    parts.append(f"{coerced(v, c.type, c.name)} AS {column(c.name)}")
            selects.append("SELECT " + ", ".join(parts))
        got = sorted(self.spark.sql(" UNION ALL ".join(selects)).collect(), key=lambda r: r[0])
        out = []
        for r in got:
            row = list(r[1:])
            for k, c in enumerate(table.columns):
                if row[k] is None and (c.auto_increment or c.hidden):
                    table.counter += 1
                    row[k] = table.counter
            out.append(tuple(row))
        return out

    def _clash(self, table: Table, rows: list[tuple], df: DataFrame) -> None:
        for key in self.catalog.uniques(table):
            at = [[c.name for c in table.columns].index(k) for k in key]
            own = [tuple(_hashable(r[k]) for k in at) for r in rows if all(r[k] is not None for k in at)]
            if len(set(own)) < len(own) or table.parts and not self.rows(table).join(F.broadcast(df.select(*key).dropna()), key, "left_semi").isEmpty():
                raise UniqueViolation(f"table {table.name}: ({', '.join(key)}) repeats")

    def _batches(self, table: Table, rows: list[tuple]) -> list[list[tuple]]:
        """The rows cut so that no key repeats within a batch."""
        names = [c.name for c in table.columns]
        out: list[list[tuple]] = []
        seen: set = set()
        for r in rows:
            keys = {(i, tuple(_hashable(r[names.index(k)]) for k in key)) for i, key in enumerate(self.catalog.uniques(table)) if all(r[names.index(k)] is not None for k in key)}
            if not out or keys & seen:
                out.append([])
                seen = set()
            out[-1].append(r)
            seen |= keys
        return out

    def _conflicts(self, table: Table, df: DataFrame) -> list[tuple[list[str], DataFrame]]:
        """Rows of the table that share a key with df, by key."""
        return [(key, self.rows(table).join(F.broadcast(df.select(*key).dropna().distinct()), key, "left_semi")) for key in self.catalog.uniques(table)]

    def _replace(self, table: Table, rows: list[tuple]) -> int:
        for batch in self._batches(table, rows):
            df = self.frame(table, batch)
            self.check_rows(table, df)
            doomed = reduce(DataFrame.union, [d.select(*table.primary) for _, d in self._conflicts(table, df)]).distinct()
            self._delete(table, doomed, keep=df)
            self.check_parents(table, df)
            self.append(table, df)
        return len(rows)

    def _upsert(self, table: Table, rows: list[tuple], sets: list) -> int:
        names = [c.name for c in table.columns]
        done = 0
        for batch in self._batches(table, rows):
            df = self.frame(table, batch)
            self.check_rows(table, df)
            found: dict[tuple, tuple] = {}
            hits: dict[int, tuple] = {}
            # conflicts are at most as many as the batch has keys
            for key, d in self._conflicts(table, df):
                at = [names.index(k) for k in key]
                have = {tuple(_hashable(r[k]) for k in at): tuple(r) for r in d.select(*names).collect()}
                for i, r in enumerate(batch):
                    if i not in hits and (old := have.get(tuple(_hashable(r[k]) for k in at))) is not None:
                        pk = tuple(_hashable(old[names.index(k)]) for k in table.primary)
                        found[pk], hits[i] = old, pk
            if found:
                if len(set(hits.values())) < len(hits):
                    raise ExecutionError("two rows of the statement update one row")
                old = self.frame(table, list(found.values()))
                self._apply(table, old.select(*table.primary), sets)
            fresh = [r for i, r in enumerate(batch) if i not in hits]
            if fresh:
                new = self.frame(table, fresh)
                self.check_parents(table, new)
                self._clash(table, fresh, new)
                self.append(table, new)
            done += len(fresh) + 2 * len(hits)
        return done

    # UPDATE

    def update(self, q: Update) -> int:
        table = self.catalog.table(q.table.name)
        writable(table)
        df = self.rows(table)
        hit = df.where(truth(compile_expr(q.where, self.scope(table, df)))) if q.where is not None else df
        keys = materialize(hit.select(*table.primary), f"{self.root}/work")
        n = keys.count()
        if n:
            self._apply(table, keys, q.sets)
        return n

    def _apply(self, table: Table, keys: DataFrame, sets: list) -> None:
        """Assign in rows with these keys; later assignments see earlier ones."""
        df = self.rows(table)
        changed = df.join(keys, table.primary, "left_semi")
        rest = df.join(keys, table.primary, "left_anti")
        olds = [f"__old_{c.name}" for c in table.columns]
        new = changed.select("*", *[F.col(column(c.name)).alias(o) for c, o in zip(table.columns, olds)])
        for name, e in sets:
            c = table.column(name)
            if e == ("default",):
                e = c.default_expr
            new = new.withColumn(name, F.expr(coerced(compile_expr(e, self.scope(table, new)), c.type, name)))
        names = {n for n, _ in sets}
        new = materialize(new, f"{self.root}/work")
        self.check_rows(table, new)
        whole = rest.unionByName(new.select(*df.columns))
        keyed = [k for k in self.catalog.uniques(table) if names & {*k}]
        if keyed:
            whole = materialize(whole, f"{self.root}/work")
            self.check_unique(table, whole, keyed)
        self.store(table, whole)
        if any(names & {*fk.columns} for fk in table.foreign):
            self.check_parents(table, new.select(*df.columns))
        self._follow(table, new, names)

    def _follow(self, table: Table, new: DataFrame, names: set[str]) -> None:
        """Carry changed parent keys into children.  new has the rows' old values as __old_<column>."""
        for child, fk in self.catalog.children(table.name):
            if not names & {*fk.parents}:
                continue
            moved = new.where(" OR ".join(f"NOT ({column(p)} <=> {column('__old_' + p)})" for p in fk.parents))
            gone = moved.select(*[F.col(column(f"__old_{p}")).alias(c) for p, c in zip(fk.parents, fk.columns)], *[F.col(column(p)).alias(f"__new_{c}") for p, c in zip(fk.parents, fk.columns)]).dropna(subset=fk.columns)
            rows = self.rows(child)
            touched = rows.join(gone, fk.columns, "left_semi")
            if touched.isEmpty():
                continue
            if fk.on_update == "RESTRICT":
                raise ForeignKeyViolation(f"table {child.name} refers to a changed key of {table.name}")
            marks = rows.join(gone.select(*fk.columns, F.lit(True).alias("__moved"), *[f"__new_{c}" for c in fk.columns]), fk.columns, "left")
            value = (lambda c: F.col(f"__new_{c}")) if fk.on_update == "CASCADE" else (lambda c: F.lit(None))
            made = marks.select(*[(F.when(F.col("__moved"), value(c.name)).otherwise(F.col(column(c.name))) if c.name in fk.columns else F.col(column(c.name))).cast(spark_type(c.type)).alias(c.name) for c in child.columns], *[F.col(column(c.name)).alias(f"__old_{c.name}") for c in child.columns], "__moved")
            made = materialize(made, f"{self.root}/work")
            own = made.where("__moved")
            self.check_rows(child, own)
            keyed = [k for k in self.catalog.uniques(child) if {*fk.columns} & {*k}]
            self.check_unique(child, made, keyed)
            self.store(child, made)
            self._follow(child, own, {*fk.columns})

    # DELETE

    def delete(self, q: Delete) -> int:
        table = self.catalog.table(q.table.name)
        writable(table)
        df = self.rows(table)
        hit = df.where(truth(compile_expr(q.where, self.scope(table, df)))) if q.where is not None else df
        keys = materialize(hit.select(*table.primary), f"{self.root}/work")
        n = keys.count()
        if n:
            self._delete(table, keys)
        return n

    def _delete(self, table: Table, keys: DataFrame, keep: DataFrame | None = None) -> None:
        """Delete rows by primary key, with what foreign keys ask for; nothing is written before all is checked.

        keep: rows about to be inserted in their place, whose keys still count as parents.
        """
        doomed = {table.name: keys}
        nulled: dict[tuple[str, int], DataFrame] = {}
        restricted: list[tuple[Table, ForeignKey, DataFrame]] = []
        todo = [(table, keys)]
        while todo:
            parent, fresh = todo.pop()
            rows = self.rows(parent).join(fresh, parent.primary, "left_semi")
            for child, fk in self.catalog.children(parent.name):
                gone = rows.select(*fk.parents).dropna().distinct()
                if keep is not None and parent.name == table.name:
                    gone = gone.join(keep.select(*fk.parents).dropna(), fk.parents, "left_anti")
                gone = gone.toDF(*fk.columns)
                hit = self.rows(child).join(gone, fk.columns, "left_semi").select(*child.primary)
                if child.name in doomed:
                    hit = hit.join(doomed[child.name], child.primary, "left_anti")
                if fk.on_delete == "RESTRICT":
                    restricted.append((child, fk, hit))
                    continue
                hit = materialize(hit, f"{self.root}/work")
                if hit.isEmpty():
                    continue
                if fk.on_delete == "CASCADE":
                    doomed[child.name] = doomed[child.name].unionByName(hit) if child.name in doomed else hit
                    todo.append((child, hit))
                else:
                    at = (child.name, child.foreign.index(fk))
                    nulled[at] = nulled[at].unionByName(hit) if at in nulled else hit
        for child, _, hit in restricted:
            if child.name in doomed:
                hit = hit.join(doomed[child.name], child.primary, "left_anti")
            if not hit.isEmpty():
                raise ForeignKeyViolation(f"table {child.name} refers to deleted rows")
        for (name, k), hit in nulled.items():
            child = self.catalog.table(name)
            fk = child.foreign[k]
            if any(not child.column(c).nullable for c in fk.columns):
                raise CheckViolation(f"table {name}: ({', '.join(fk.columns)}) can't be NULL")
            marks = self.rows(child).join(hit.distinct().withColumn("__hit", F.lit(True)), child.primary, "left")
            self.store(child, marks.select(*[(F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(column(c.name))) if c.name in fk.columns else F.col(column(c.name))).alias(c.name) for c in child.columns]))
        for name, gone in doomed.items():
            t = self.catalog.table(name)
            self.store(t, self.rows(t).join(gone.distinct(), t.primary, "left_anti"))


def writable(table: Table) -> None:
    if table.source is not None:
        raise ExecutionError(f"table {table.name} is read only")


def _hashable(v):
    return bytes(v) if isinstance(v, bytearray) else v
