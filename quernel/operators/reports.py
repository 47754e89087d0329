"""SHOW, DESCRIBE, EXPLAIN and ANALYZE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ExecutionError
from ..plans.expressions import column
from ..sources.catalog import Catalog, Index, Table
from ..sql.tree import Delete, Select, Update, walk

BINS = 16
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _default(value: list | None) -> str | None:
    if value is None:
        return None
    kind, v = value
    return "NULL" if kind == "null" else f"{v:g}" if kind == "float" else str(v)


def _foreign(fk) -> str:
    return f"FOREIGN KEY ({', '.join(fk.columns)}) REFERENCES {fk.table}({', '.join(fk.parents)}) ON DELETE {fk.on_delete} ON UPDATE {fk.on_update}"


def create_text(catalog: Catalog, table: Table) -> str:
    """The statement that makes the table."""
    lines = []
    for c in table.columns:
        if c.hidden:
            continue
        line = f"{c.name} {c.type}"
        key = table.primary == [c.name]
        line += " PRIMARY KEY" * key + " AUTO_INCREMENT" * c.auto_increment + " UNIQUE" * (c.unique and c.name not in table.primary)
        line += " NOT NULL" * (not c.nullable and c.name not in table.primary)
        if c.default is not None:
            line += f" DEFAULT '{c.default[1]}'" if c.default[0] == "str" else f" DEFAULT {_default(c.default)}"
        lines.append(line + (f" CHECK ({c.check})" if c.check else ""))
    if len(table.primary) > 1:
        lines.append(f"PRIMARY KEY ({', '.join(table.primary)})")
    lines += [f"UNIQUE ({', '.join(i.columns)})" for i in catalog.of_table(table.name) if i.unique and len(i.columns) > 1]
    lines += [_foreign(fk) for fk in table.foreign]
    return f"CREATE TABLE {table.name} (\n" + ",\n".join(f"  {x}" for x in lines) + "\n)"


def describe(table: Table) -> list[tuple]:
    rows = [(c.name, str(c.type), "YES" if c.nullable else "NO", "PRI" if c.name in table.primary else "UNI" if c.unique else "", _default(c.default) or "NULL", "auto_increment" if c.auto_increment else "") for c in table.columns if not c.hidden]
    return rows + [("CONSTRAINT", _foreign(fk), "", "FK", "", f"ON DELETE {fk.on_delete} ON UPDATE {fk.on_update}") for fk in table.foreign]


def analyze(spark: SparkSession, catalog: Catalog, table: Table) -> int:
    """Row count; distinct keys of each index; bounds and equal-width histogram of integer and time columns."""
    rows = table.rows(spark)
    indexes = [i for i in catalog.of_table(table.name) if not i.fulltext]
    numbers = {}
    for i in indexes:
        kind = table.column(i.columns[0]).type.name
        if len(i.columns) == 1 and kind in ("TINYINT", "SMALLINT", "INT", "BIGINT", "DATE", "DATETIME", "TIMESTAMP"):
            c = F.col(column(i.columns[0]))
            numbers[i.name] = F.unix_date(c).cast("long") if kind == "DATE" else F.unix_micros(c.cast("timestamp")) / 1_000_000 if kind in ("DATETIME", "TIMESTAMP") else c.cast("long")
            numbers[i.name] = numbers[i.name].cast("long")
    parts = [F.count(F.lit(1)).alias("n")]
    for k, i in enumerate(indexes):
        parts.append(F.count_distinct(*[F.col(column(c)) for c in i.columns]).alias(f"d{k}"))
        if i.name in numbers:
            parts += [F.min(numbers[i.name]).alias(f"lo{k}"), F.max(numbers[i.name]).alias(f"hi{k}")]
    got = rows.agg(*parts).first()
    table.analyzed = got["n"]
    histograms = []
    for k, i in enumerate(indexes):
        i.distinct, i.low, i.high, i.bins = got[f"d{k}"], None, None, []
        if i.name in numbers and got[f"lo{k}"] is not None:
            i.low, i.high = got[f"lo{k}"], got[f"hi{k}"]
            width = max(1, -(-(i.high - i.low + 1) // BINS))
            bin_ = F.least(F.floor((numbers[i.name] - F.lit(i.low)) / F.lit(width)), F.lit(BINS - 1))
            histograms += [F.count_if(bin_ == b).alias(f"b{k}_{b}") for b in range(BINS)]
    if histograms:
        counts = rows.agg(*histograms).first()
        for k, i in enumerate(indexes):
            if i.low is not None:
                i.bins = [counts[f"b{k}_{b}"] for b in range(BINS)]
    return got["n"]


def _conjuncts(e) -> list:
    return _conjuncts(e[2]) + _conjuncts(e[3]) if e is not None and e[0] == "bin" and e[1] == "AND" else [] if e is None else [e]


def _up(a: int, b: int) -> int:
    return -(-a // b)


def _seek(rows: int, parts: int, index: Index | None, whole: bool) -> int:
    if parts == 0:
        return max(rows, 1)
    if whole:
        return 1
    out = _up(max(rows, 1), index.distinct if index and index.distinct else 4)
    for _ in range(parts - 1):
        out = _up(out, 2)
    return min(max(out, 1), max(rows, 1))


def _in_range(index: Index, rows: int, bounds: dict) -> int | None:
    """Rows by histogram, or by bounds, if the range is of integer literals."""
    if index.low is None or not all(e[0] == "lit" and e[1] == "int" for e, _ in bounds.values()):
        return None
    lo = max(index.low, bounds["lower"][0][2] + (not bounds["lower"][1])) if "lower" in bounds else index.low
    hi = min(index.high, bounds["upper"][0][2] - (not bounds["upper"][1])) if "upper" in bounds else index.high
    if lo > hi:
        return 1
    if sum(index.bins):
        width = max(1, _up(index.high - index.low + 1, BINS))
        hit = 0.0
        for b, n in enumerate(index.bins):
            a, z = index.low + b * width, min(index.low + (b + 1) * width - 1, index.high)
            if n and (share := min(z, hi) - max(a, lo) + 1) > 0:
                hit += n * share / (z - a + 1)
        return max(1, round(hit * rows / sum(index.bins)))
    return max(1, _up(rows * (hi - lo + 1), index.high - index.low + 1))


def access_path(catalog: Catalog, table: Table, where, hints: list, rows: int) -> tuple[str, str | None, int, int]:
    """(type, key, rows, cost) of the way in which an indexed row store would read the table."""
    terms = _conjuncts(where)
    for e in terms:
        inner = e[2] if e[0] == "bin" and e[1] == ">" and e[3] == ("lit", "int", 0) else e
        if inner[0] == "match":
            own = [i.name for i in catalog.of_table(table.name) if i.fulltext and i.columns == [inner[1]]]
            n = max(1, _up(rows * 3, 10))
            return "fulltext", own[0] if own else f"fts_{inner[1]}", n, 2000 + 2 * n
    equal, ranges = {}, {}
    for e in terms:
        if e[0] == "bin" and e[1] in ("=", *_FLIP):
            for op, a, b in ((e[1], e[2], e[3]), (_FLIP.get(e[1], "="), e[3], e[2])):
                if a[0] == "col" and not any(x[0] in ("col", "sub") for x in walk(b)):
                    if op == "=":
                        equal.setdefault(a[2], b)
                    else:
                        ranges.setdefault(a[2], {})["lower" if op[0] == ">" else "upper"] = (b, op.endswith("="))
        elif e[0] == "between" and not e[4] and e[1][0] == "col":
            ranges.setdefault(e[1][2], {}).update(lower=(e[2], True), upper=(e[3], True))
    force = any(k == "FORCE" for k, _ in hints)
    only = {n for k, names in hints if k in ("FORCE", "USE") for n in names}
    never = {n for k, names in hints if k == "IGNORE" for n in names}
    if not force and table.primary and all(k in equal for k in table.primary):
        return "const", "PRIMARY", 1, 101
    best = []
    for i in catalog.of_table(table.name):
        if i.fulltext or i.name in never or (only or force) and i.name not in only:
            continue
        prefix = next((k for k, c in enumerate(i.columns) if c not in equal), len(i.columns))
        if prefix == len(i.columns):
            n = _seek(rows, prefix, i, i.unique)
            best.append((1500 - 300 * prefix + 3 * n, f"0:{i.name}", "ref", i.name, n))
        if prefix == len(i.columns) - 1 and i.columns[-1] in ranges or len(i.columns) == 1 and i.columns[0] in ranges:
            prefix = 0 if len(i.columns) == 1 else prefix
            bounds = ranges[i.columns[-1]]
            n = _seek(rows, prefix, i, False)
            n = (_in_range(i, n, bounds) if prefix == 0 else None) or _up(n, 5 if len(bounds) == 2 else 2)
            n = min(max(n, 1), rows)
            best.append((max(0, 1400 - 250 * prefix - 250 * len(bounds)) + 3 * n, f"1:{i.name}", "range", i.name, n))
    if best:
        cost, _, kind, key, n = min(best)
        return kind, key, n, cost
    return "ALL", None, rows, 3000 + 5 * rows


def explain(spark: SparkSession, catalog: Catalog, q) -> list[tuple]:
    """(id, select_type, table, type, key, rows, cost, Extra)."""
    if not isinstance(q, Select | Update | Delete) or q.table is None:
        raise ExecutionError("EXPLAIN takes SELECT with FROM, UPDATE or DELETE")
    table = catalog.table(q.table.name)
    live = lambda t: t.analyzed or max(1, t.rows(spark).count())
    kind, key, _, cost = access_path(catalog, table, q.where, q.table.hints, table.analyzed or 10_000)
    _, _, rows, _ = access_path(catalog, table, q.where, q.table.hints, live(table))
    extra = {"const": "Using where", "ref": "Using where; Using index", "range": "Using where; Using index", "fulltext": "Using where; Using fulltext"}.get(kind, "Using where" if q.where is not None else "")
    notes, left = [], None
    for k, j in enumerate(q.joins if isinstance(q, Select) else []):
        if j.kind in ("inner", "cross"):
            left = left or live(table)
            right = live(catalog.table(j.table.name))
            notes.append(f"j{k + 1}={'left_outer' if left <= right else 'right_outer'} (L={left},R={right})")
            left = max(1, left * right)
    if notes:
        extra = "; ".join(filter(None, [extra, f"Join loops: {', '.join(notes)}"]))
    name = {Select: "SIMPLE", Update: "UPDATE", Delete: "DELETE"}[type(q)]
    return [(1, name, table.name, kind, key, rows, cost, extra or None)]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
