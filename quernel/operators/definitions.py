"""CREATE, ALTER, DROP and RENAME on a statement's copy of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import CheckViolation, ForeignKeyViolation, SchemaError, UniqueViolation
from ..plans.expressions import Scope, column, compile_expr, kind_of
from ..sources.catalog import ROWID, Catalog, Column, Index, Table
from ..sql.tree import AlterTable, ColumnSpec, CreateFulltext, CreateIndex, CreateTable, ForeignKey, RenameTable, Type
from .changes import Changes, coerced, writable


def create_table(catalog: Catalog, q: CreateTable) -> None:
    if q.name in catalog.tables:
        if q.if_not_exists:
            return
        raise SchemaError(f"table {q.name} exists")
    columns = [Column.of(c) for c in q.columns]
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise SchemaError("a column repeats")
    inline = [c.name for c in q.columns if c.primary]
    if len(inline) > 1 or inline and q.primary:
        raise SchemaError("more than one primary key")
    primary = q.primary or inline
    uniques = [[c.name] for c in q.columns if c.unique and not c.primary] + [cols for _, cols in q.uniques]
    for cols in (primary, *uniques, *[fk.columns for fk in q.foreign]):
        for name in cols:
            if name not in names:
                raise SchemaError(f"unknown column {name}")
    for c, spec in zip(columns, q.columns):
        if c.auto_increment and c.type.name not in ("TINYINT", "SMALLINT", "INT", "BIGINT"):
            raise SchemaError(f"AUTO_INCREMENT column {c.name} must be an integer")
        if c.name in primary:
            c.nullable = False
        if spec.check is not None:
            compile_expr(spec.check, Scope({(q.name, s.name): (column(s.name), _kind(s.type)) for s in q.columns}))
    if not primary:
        columns.append(Column(ROWID, Type("BIGINT"), nullable=False, hidden=True))
        primary = [ROWID]
    table = Table(q.name, columns, primary, stored=[c.name for c in columns])
    catalog.tables[q.name] = table
    for (label, cols) in [*[(None, u) for u in uniques[: len(uniques) - len(q.uniques)]], *q.uniques]:
        name = label or f"auto_unique_{q.name}_{'_'.join(cols)}"
        if name in catalog.indexes:
            raise SchemaError(f"index {name} exists")
        catalog.indexes[name] = Index(name, q.name, cols, True)
        if len(cols) == 1:
            table.column(cols[0]).unique = True
    for fk in q.foreign:
        _check_foreign(catalog, table, fk)
        table.foreign.append(fk)


def _kind(t: Type) -> str:
    from ..sources.catalog import spark_type

    return kind_of(spark_type(t))


def _check_foreign(catalog: Catalog, table: Table, fk: ForeignKey) -> None:
    parent = catalog.table(fk.table)
    if len(fk.columns) != len(fk.parents):
        raise SchemaError("a foreign key has as many columns as it refers to")
    for a, b in zip(fk.columns, fk.parents):
        if str(table.column(a).type) != str(parent.column(b).type) and {table.column(a).type.name, parent.column(b).type.name} != {"VARCHAR"}:
            raise SchemaError(f"types of {a} and {fk.table}.{b} differ")
    if sorted(fk.parents) not in [sorted(k) for k in catalog.uniques(parent)]:
        raise SchemaError(f"({', '.join(fk.parents)}) is no key of {fk.table}")
    if any(sorted(o.columns) == sorted(fk.columns) and o.table == fk.table for o in table.foreign):
        raise SchemaError("the foreign key exists")
    for action, name in ((fk.on_delete, "DELETE"), (fk.on_update, "UPDATE")):
        if action == "SET NULL" and any(not table.column(c).nullable for c in fk.columns):
            raise SchemaError(f"ON {name} SET NULL needs columns that can be NULL")


def create_index(changes: Changes, q: CreateIndex) -> None:
    catalog = changes.catalog
    if q.name in catalog.indexes:
        if q.if_not_exists:
            return
        raise SchemaError(f"index {q.name} exists")
    table = catalog.table(q.table)
    for c in q.columns:
        table.column(c)
    if q.unique:
        changes.check_unique(table, changes.rows(table), [q.columns])
        if len(q.columns) == 1:
            table.column(q.columns[0]).unique = True
    catalog.indexes[q.name] = Index(q.name, q.table, q.columns, q.unique)


def create_fulltext(catalog: Catalog, q: CreateFulltext) -> None:
    if q.name in catalog.indexes:
        raise SchemaError(f"index {q.name} exists")
    c = catalog.table(q.table).column(q.column)
    if c.type.name not in ("VARCHAR", "TEXT"):
        raise SchemaError("a full-text index needs a text column")
    o = q.options
    if o["parser"].lower() != "ngram" or o["n"] != 2 or o["normalize"].lower() != "nfkc":
        raise SchemaError("full-text indexes have parser ngram, n=2, normalize='nfkc'")
    if o["stop_df_ratio_ppm"] > 1_000_000:
        raise SchemaError("stop_df_ratio_ppm is at most 1000000")
    catalog.indexes[q.name] = Index(q.name, q.table, [q.column], fulltext=o)


def drop_table(catalog: Catalog, name: str, if_exists: bool) -> None:
    if name not in catalog.tables:
        if if_exists:
            return
        raise SchemaError(f"table {name} not found")
    if any(t.name != name for t, _ in catalog.children(name)):
        raise ForeignKeyViolation(f"table {name} is referred to")
    del catalog.tables[name]
    catalog.indexes = {k: i for k, i in catalog.indexes.items() if i.table != name}


def drop_index(catalog: Catalog, name: str, if_exists: bool) -> None:
    if name not in catalog.indexes:
        if if_exists:
            return
        raise SchemaError(f"index {name} not found")
    index = catalog.indexes.pop(name)
    if index.unique and len(index.columns) == 1:
        catalog.table(index.table).column(index.columns[0]).unique = False


def rename_table(catalog: Catalog, q: RenameTable) -> None:
    table = catalog.table(q.old)
    if q.new in catalog.tables:
        raise SchemaError(f"table {q.new} exists")
    catalog.tables = {q.new if k == q.old else k: t for k, t in catalog.tables.items()}
    table.name = q.new
    for i in catalog.of_table(q.old):
        i.table = q.new
    for t in catalog.tables.values():
        for fk in t.foreign:
            if fk.table == q.old:
                fk.table = q.new


def alter_table(changes: Changes, q: AlterTable) -> None:
    catalog, table = changes.catalog, changes.catalog.table(q.table)
    writable(table)
    if q.action == "add":
        _add_column(changes, table, q.column)
    elif q.action == "drop":
        _drop_column(changes, table, q.old)
    elif q.action in ("modify", "change"):
        _change_column(changes, table, q.old or q.column.name, q.column)
    elif q.action == "add foreign":
        _check_foreign(catalog, table, q.foreign)
        table.foreign.append(q.foreign)
        changes.check_parents(table, changes.rows(table))
    else:
        hits = [fk for fk in table.foreign if fk.columns == q.names]
        if len(hits) != 1:
            raise SchemaError("the foreign key is ambiguous" if hits else "no such foreign key")
        table.foreign.remove(hits[0])


def _add_column(changes: Changes, table: Table, spec: ColumnSpec) -> None:
    if any(c.name == spec.name for c in table.columns):
        raise SchemaError(f"column {spec.name} exists")
    if spec.primary:
        raise SchemaError("a primary key can't be added")
    new = Column.of(spec)
    rows = changes.rows(table)
    default = compile_expr(new.default_expr, Scope())
    if default[1] != "null":
        changes.spark.range(1).selectExpr(f"{coerced(default, new.type, new.name)} AS v").collect()
    if not spec.nullable and default[1] == "null" and not rows.isEmpty():
        raise CheckViolation(f"column {spec.name} is NOT NULL and has no default")
    if spec.unique:
        if default[1] != "null" and rows.limit(2).count() > 1:
            raise UniqueViolation(f"column {spec.name} would repeat its default")
        name = f"auto_unique_{table.name}_{spec.name}"
        changes.catalog.indexes[name] = Index(name, table.name, [spec.name], True)
    table.columns.insert(len(table.visible), new)


def _drop_column(changes: Changes, table: Table, name: str) -> None:
    table.column(name)
    if name in table.primary or any(name in i.columns for i in changes.catalog.of_table(table.name)):
        raise SchemaError(f"column {name} is part of a key or an index")
    if any(name in fk.columns for fk in table.foreign) or any(name in fk.parents for _, fk in changes.catalog.children(table.name)):
        raise SchemaError(f"column {name} is part of a foreign key")
    if len(table.visible) == 1:
        raise SchemaError("a table keeps at least one column")
    rows = changes.rows(table)
    table.columns = [c for c in table.columns if c.name != name]
    changes.store(table, rows.drop(name))


def _change_column(changes: Changes, table: Table, old: str, spec: ColumnSpec) -> None:
    catalog, before = changes.catalog, table.column(old)
    new = Column.of(spec)
    if spec.name != old and any(c.name == spec.name for c in table.columns):
        raise SchemaError(f"column {spec.name} exists")
    retyped = str(before.type) != str(new.type)
    keyed = any(old in fk.columns for fk in table.foreign) or any(old in fk.parents for _, fk in catalog.children(table.name))
    if retyped and keyed:
        raise SchemaError(f"column {old} is part of a foreign key")
    if old in table.primary:
        new.nullable = False
    if any(i.fulltext and old in i.columns for i in catalog.of_table(table.name)) and new.type.name not in ("VARCHAR", "TEXT"):
        raise SchemaError(f"column {old} has a full-text index")
    rows = changes.rows(table)
    value = coerced((column(old), kind_of(rows.schema[old].dataType)), new.type, spec.name) if retyped else column(old)
    made: DataFrame = rows.select(*[F.expr(value).alias(spec.name) if c.name == old else F.col(column(c.name)) for c in table.columns])
    table.columns = [new if c.name == old else c for c in table.columns]
    table.primary = [spec.name if k == old else k for k in table.primary]
    for i in catalog.of_table(table.name):
        i.columns = [spec.name if k == old else k for k in i.columns]
    for fk in table.foreign:
        fk.columns = [spec.name if k == old else k for k in fk.columns]
    for _, fk in catalog.children(table.name):
        fk.parents = [spec.name if k == old else k for k in fk.parents]
    changes.store(table, made)
    rows = changes.rows(table)
    if not new.nullable and not rows.where(F.col(column(spec.name)).isNull()).isEmpty():
        raise CheckViolation(f"column {spec.name} is NOT NULL")
    own = [i for i in catalog.of_table(table.name) if i.unique and i.columns == [spec.name]]
    if spec.unique and not own:
        changes.check_unique(table, rows, [[spec.name]])
        name = f"auto_unique_{table.name}_{spec.name}"
        catalog.indexes[name] = Index(name, table.name, [spec.name], True)
    elif not spec.unique:
        for i in own:
            del catalog.indexes[i.name]
    if [spec.name] in catalog.uniques(table) and retyped:
        changes.check_unique(table, rows, [[spec.name]])


__all__ = ["alter_table", "create_fulltext", "create_index", "create_table", "drop_index", "drop_table", "rename_table"]
