"""The engine: statements of the dialect over Spark.

Queries return lazy DataFrames; changes return the number of affected rows.  Each statement outside a transaction commits by
itself; inside one, changes are seen by the session alone until COMMIT.  A statement works on its own copy of the catalog, so a
failed one leaves nothing behind.
"""

from __future__ import annotations

import base64
import datetime
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .errors import Cancelled, ExecutionError, LockError, ParseError, StatementTimeout, TransactionError
from .functions import arrow
from .operators import definitions, reports
from .operators.changes import Changes
from .operators.fulltext import normalised
from .plans.expressions import column
from .plans.select import Planner, Source
from .sources.catalog import Catalog, Column, Table
from .sources.storage import Files, workspace
from .sql.parser import parse
from .sql.tree import (
    AlterTable, Analyze, CreateFulltext, CreateIndex, CreateTable, Delete, DropIndex, DropTable, Explain, Insert, RenameTable, Select, SetOption, SetQuery, Show, Transaction, Type, Update,
)

_READS = (Select, SetQuery, Show, Explain)


@dataclass
class Prepared:
    """A parsed statement and its number of parameters."""

    sql: str
    statement: object
    count: int


def _literal(value) -> tuple:
    """A Python value as a literal of the dialect."""
    if value is None:
        return ("lit", "null", None)
    if isinstance(value, bool):
        return ("lit", "int", int(value))
    for kinds, name in ((int, "int"), (float, "float"), (str, "str"), ((bytes, bytearray), "bin"), (Decimal, "dec"), (datetime.datetime, "dt"), (datetime.date, "date")):
        if isinstance(value, kinds):
            return ("lit", name, bytes(value) if name == "bin" else value)
    if isinstance(value, uuid.UUID):
        return ("lit", "str", str(value))
    raise ExecutionError(f"can't bind a {type(value).__name__}")


def _bind(node, values: list):
    """A statement with its parameters replaced."""
    if isinstance(node, tuple):
        if node and node[0] == "param":
            return _literal(values[node[1]])
        return tuple(_bind(x, values) for x in node)
    if isinstance(node, list):
        return [_bind(x, values) for x in node]
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, Type):
        out = object.__new__(type(node))
        out.__dict__ = {k: _bind(v, values) for k, v in node.__dict__.items()}
        return out
    return node


class Engine:
    """One session.  With ``root`` (a URI) tables persist there and other sessions see commits; else they live with the session."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.files = spark, Files(spark)
        self.root = (root or workspace(spark)).rstrip("/")
        self.shared = root is not None
        self.catalog, self.transaction = Catalog(), None
        self.savepoints: list[tuple[str, Catalog]] = []
        self.options = {"checkpoint_tx_threshold": 256, "checkpoint_wal_bytes_threshold": 64 << 20, "checkpoint_interval_ms": 60_000}
        self.counters = {"total_checkpoints": 0, "failed_checkpoints": 0, "commits": 0, "rollbacks": 0}
        self.busy_timeout_ms, self.statement_timeout_ms = 0, None
        self.read_only = False
        self._nfkc: dict[tuple, bool] = {}
        self._running: str | None = None
        self._cancelled = False
        arrow.register(spark)
        self.refresh()

    # catalog

    def refresh(self) -> None:
        """Read what other sessions published."""
        if self.shared and (own := sorted(n for n in self.files.names(f"{self.root}/catalog") if n.endswith(".json"))):
            if int(own[-1][:-5]) != self.catalog.version:
                outside = {k: t for k, t in self.catalog.tables.items() if t.source is not None}
                indexes = {k: i for k, i in self.catalog.indexes.items() if i.table in outside}
                self.catalog = Catalog.loads(self.files.read(f"{self.root}/catalog/{own[-1]}"))
                self.catalog.tables |= outside
                self.catalog.indexes |= indexes

    def _publish(self, new: Catalog) -> None:
        new.version = self.catalog.version + 1
        if self.shared and not self.files.publish(f"{self.root}/catalog/{new.version:012d}.json", new.dumps()):
            raise LockError("another session committed first")
        self.catalog = new
        self.counters["commits"] += 1

    @property
    def current(self) -> Catalog:
        return self.transaction or self.catalog

    def register(self, name: str, source: str | DataFrame, primary: list[str] | None = None, fulltext: list[str] | None = None, **options) -> None:
        """Make a Parquet folder or a DataFrame readable as a table."""
        get: Callable[[], DataFrame] = (lambda: source) if isinstance(source, DataFrame) else (lambda: self.spark.read.parquet(source))
        kinds = {"int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "date": "DATE", "dt": "DATETIME", "bin": "VARBINARY"}
        from .plans.expressions import kind_of

        rows = get()
        columns = [Column(f.name, Type(kinds.get(kind_of(f.dataType), "TEXT"))) for f in rows.schema]
        for c in columns:
            c.nullable = c.name not in (primary or [])
        self.catalog.tables[name] = Table(name, columns, primary or [], source=lambda: rows)
        for c in fulltext or []:
            definitions.create_fulltext(self.catalog, CreateFulltext(f"fts_{name}_{c}", name, c, {"parser": "ngram", "n": 2, "normalize": "nfkc", "stop_filter": False, "stop_df_ratio_ppm": 200_000} | options))

    def load(self, name: str, df: DataFrame, primary: list[str]) -> None:
        """Make a table from a DataFrame's rows: a bulk insert into a new table, in one distributed write."""
        from .plans.expressions import kind_of

        kinds = {"int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "date": "DATE", "dt": "DATETIME", "bin": "VARBINARY"}
        work = self.current.copy()
        if name in work.tables:
            raise ExecutionError(f"table {name} exists")
        columns = [Column(f.name, Type(kinds.get(kind_of(f.dataType), "TEXT")), nullable=f.name not in primary) for f in df.schema]
        table = work.tables[name] = Table(name, columns, primary, stored=[c.name for c in columns])
        changes = Changes(self.spark, work, f"{self.root}/data", None)
        changes.store(table, df)
        changes.check_rows(table, table.rows(self.spark))
        changes.check_unique(table, table.rows(self.spark), [primary])
        if self.transaction:
            self.transaction = work
        else:
            self._publish(work)

    def _source(self, catalog: Catalog, name: str) -> Source:
        table = catalog.table(name)
        rows = table.rows(self.spark)

        def ready(c: str) -> bool:
            key = (name, c, tuple(table.parts), id(table.source))
            if key not in self._nfkc:
                self._nfkc[key] = normalised(rows, column(c))
            return self._nfkc[key]

        return Source(rows, table.visible, table.primary, {i.columns[0]: i.fulltext for i in catalog.of_table(name) if i.fulltext}, ready)

    def _planner(self, catalog: Catalog) -> Planner:
        return Planner(self.spark, lambda n: self._source(catalog, n))

    # statements

    def execute(self, sql: str, params: list | tuple | None = None) -> DataFrame | int | None:
        """Run a statement: rows, a number of affected rows, or nothing."""
        q = parse(sql)
        return self._run(q, getattr(q, "params", 0), params)

    def query(self, sql: str, params: list | tuple | None = None) -> DataFrame:
        """Run a statement that only reads."""
        q = parse(sql)
        if not isinstance(q, _READS):
            raise ExecutionError("query() takes statements that only read")
        return self._run(q, getattr(q, "params", 0), params)

    def rows(self, sql: str, params: list | tuple | None = None) -> list:
        """All rows of a query, under the statement timeout and the cancel handle."""
        return self._guarded(lambda: self.query(sql, params).collect())

    def prepare(self, sql: str) -> Prepared:
        q = parse(sql)
        return Prepared(sql, q, getattr(q, "params", 0))

    def execute_prepared(self, p: Prepared, params: list | tuple = ()) -> DataFrame | int | None:
        return self._run(p.statement, p.count, params)

    def query_prepared(self, p: Prepared, params: list | tuple = ()) -> DataFrame:
        if not isinstance(p.statement, _READS):
            raise ExecutionError("query_prepared() takes statements that only read")
        return self._run(p.statement, p.count, params)

    def execute_params(self, sql: str, params: list | tuple) -> DataFrame | int | None:
        return self.execute(sql, params)

    def query_params(self, sql: str, params: list | tuple) -> DataFrame:
        return self.query(sql, params)

    @staticmethod
    def classify_sql(sql: str) -> str:
        """read, write or transaction."""
        q = parse(sql)
        return "transaction" if isinstance(q, Transaction) else "read" if isinstance(q, _READS) else "write"

    def _run(self, q, count: int, params: list | tuple | None):
        values = list(params or [])
        if len(values) != count:
            raise ExecutionError(f"{count} parameters, {len(values)} values")
        if count:
            q = _bind(q, values)
        if isinstance(q, Transaction):
            return self._transact(q)
        if isinstance(q, SetOption):
            if self.transaction:
                raise TransactionError("SET inside a transaction")
            self.options[q.name] = q.value
            return None
        if isinstance(q, _READS):
            if not self.transaction:
                self.refresh()
            return self._read(q, self.current)
        if self.read_only:
            raise ExecutionError("this session only reads")
        return self._guarded(lambda: self._write(q))

    def _write(self, q):
        end = time.monotonic() + self.busy_timeout_ms / 1000
        while True:
            if not self.transaction:
                self.refresh()
            work = self.current.copy()
            out = self._change(q, work)
            if self.transaction:
                self.transaction = work
                return out
            try:
                self._publish(work)
                return out
            except LockError:
                if time.monotonic() >= end:
                    raise
                time.sleep(0.02)

    def _change(self, q, work: Catalog):
        planner = self._planner(work)
        changes = Changes(self.spark, work, f"{self.root}/data", planner.query)
        if isinstance(q, Insert):
            return changes.insert(q)
        if isinstance(q, Update | Delete) and q.where is not None:
            q = replace(q, where=planner.searches([q.where], q.table.name)[0])
        if isinstance(q, Update):
            values = planner.searches([v for _, v in q.sets], q.table.name)
            return changes.update(replace(q, sets=[(n, v) for (n, _), v in zip(q.sets, values)]))
        if isinstance(q, Delete):
            return changes.delete(q)
        if isinstance(q, CreateTable):
            return definitions.create_table(work, q)
        if isinstance(q, CreateIndex):
            return definitions.create_index(changes, q)
        if isinstance(q, CreateFulltext):
            return definitions.create_fulltext(work, q)
        if isinstance(q, DropTable):
            return definitions.drop_table(work, q.name, q.if_exists)
        if isinstance(q, DropIndex):
            return definitions.drop_index(work, q.name, q.if_exists)
        if isinstance(q, AlterTable):
            return definitions.alter_table(changes, q)
        if isinstance(q, RenameTable):
            return definitions.rename_table(work, q)
        if isinstance(q, Analyze):
            reports.analyze(self.spark, work, work.table(q.table))
            return None
        raise ParseError(f"can't run {type(q).__name__}")

    def _read(self, q, catalog: Catalog) -> DataFrame:
        if isinstance(q, Select | SetQuery):
            return self._planner(catalog).query(q)
        frame = lambda rows, schema: reports.frame(self.spark, rows, schema)
        if isinstance(q, Explain):
            return frame(reports.explain(self.spark, catalog, q.statement), "id long, select_type string, table string, type string, key string, rows long, cost long, Extra string")
        if q.what == "tables":
            return frame([(n,) for n in sorted(catalog.tables)], "Table string")
        if q.what == "create":
            return frame([(q.name, reports.create_text(catalog, catalog.table(q.name)))], "Table string, `Create Table` string")
        if q.what == "describe":
            return frame(reports.describe(catalog.table(q.name)), "Field string, Type string, Null string, Key string, Default string, Extra string")
        stats = {k: self.counters[k] for k in ("total_checkpoints", "failed_checkpoints")} | {"last_failure_error": "", "last_failure_timestamp_ms": ""}
        if q.what == "database":
            pending = sum(max(0, len(t.parts) - 1) for t in catalog.tables.values())
            stats |= dict.fromkeys(["commit_in_doubt_count", "freelist_sanitize_count", "freelist_out_of_range_total", "freelist_duplicates_total", "pager_cache_hits", "pager_cache_misses", "wal_file_size_bytes"], 0)
            stats |= {"last_commit_in_doubt_error": "", "last_commit_in_doubt_timestamp_ms": "", "pager_cache_hit_rate_pct": "0.00", "deferred_checkpoints": 0, "checkpoint_pending_ops": pending, "checkpoint_policy_tx_threshold": self.options["checkpoint_tx_threshold"], "checkpoint_policy_wal_bytes_threshold": self.options["checkpoint_wal_bytes_threshold"], "checkpoint_policy_interval_ms": self.options["checkpoint_interval_ms"]}
        return frame([(k, str(v)) for k, v in stats.items()], "stat string, value string")

    # transactions

    def _transact(self, q: Transaction) -> None:
        verb = q.verb
        if verb == "BEGIN":
            if self.transaction:
                raise TransactionError("a transaction is open")
            self.refresh()
            self.transaction, self.savepoints = self.catalog.copy(), []
            return
        if not self.transaction:
            raise TransactionError(f"{verb} without BEGIN")
        names = [n for n, _ in self.savepoints]
        if verb == "COMMIT":
            try:
                self._publish(self.transaction)
            finally:
                self.transaction, self.savepoints = None, []
        elif verb == "ROLLBACK":
            self.transaction, self.savepoints = None, []
            self.counters["rollbacks"] += 1
        elif verb == "SAVEPOINT":
            self.savepoints = [(n, c) for n, c in self.savepoints if n != q.name] + [(q.name, self.transaction.copy())]
        elif q.name not in names:
            raise TransactionError(f"no savepoint {q.name}")
        elif verb == "ROLLBACK TO":
            self.savepoints = self.savepoints[: names.index(q.name) + 1]
            self.transaction = self.savepoints[-1][1].copy()
        else:
            del self.savepoints[names.index(q.name)]

    # control

    def set_busy_timeout_ms(self, ms: int) -> None:
        """How long a commit tries again when another session was first."""
        self.busy_timeout_ms = ms

    def set_statement_timeout_ms(self, ms: int | None) -> None:
        self.statement_timeout_ms = ms

    def _guarded(self, work: Callable):
        """Run Spark jobs under a tag that can be interrupted."""
        sc = self.spark.sparkContext
        tag = self._running = f"quernel-{uuid.uuid4().hex}"
        self._cancelled, late = False, threading.Event()
        sc.addJobTag(tag)

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.statement_timeout_ms / 1000, stop) if self.statement_timeout_ms else None
        if timer:
            timer.start()
        try:
            out = work()
            if late.is_set():
                raise StatementTimeout(f"the statement took more than {self.statement_timeout_ms} ms")
            return out
        except Exception as e:
            if late.is_set():
                raise StatementTimeout(f"the statement took more than {self.statement_timeout_ms} ms") from e
            if self._cancelled:
                raise Cancelled("the statement was cancelled") from e
            raise
        finally:
            self._running = None
            sc.removeJobTag(tag)
            if timer:
                timer.cancel()

    def cancel_handle(self) -> Callable[[], bool]:
        """A function for other threads; it returns whether a statement was running."""

        def cancel() -> bool:
            tag = self._running
            if tag is None:
                return False
            self._cancelled = True
            self.spark.sparkContext.cancelJobsWithTag(tag)
            return True

        return cancel

    def open_reader(self) -> Engine:
        """Another session on the same tables that only reads."""
        out = Engine(self.spark, self.root if self.shared else None)
        if not self.shared:
            out.root, out.catalog = self.root, self.catalog
        out.read_only = True
        return out

    def flush(self) -> None:
        """Compact snapshots of several folders into one."""
        if self.read_only or self.transaction:
            raise TransactionError("flush outside transactions, in a writing session")
        work = self.catalog.copy()
        changes = Changes(self.spark, work, f"{self.root}/data", None)
        many = [t for t in work.tables.values() if len(t.parts) > 1]
        for t in many:
            changes.store(t, changes.rows(t))
        if many:
            self._publish(work)
        self.counters["total_checkpoints"] += 1

    def backup(self, uri: str) -> None:
        """Copy the committed state to a new folder, which Engine(spark, uri) opens."""
        if self.files.exists(uri):
            raise ExecutionError(f"{uri} exists")
        work = self.catalog.copy()
        for t in work.tables.values():
            moved = []
            for p in t.parts:
                moved.append(f"{uri}/data/{t.name}/{p.rpartition('/')[2]}")
                self.files.copy(p, moved[-1])
            t.parts = moved
        work.version = 1
        self.files.publish(f"{uri}/catalog/{1:012d}.json", work.dumps())

    def rekey_with_password(self, *_: str) -> None:
        raise ExecutionError("tables are plain Parquet; encryption is the store's affair")

    # output

    @staticmethod
    def to_json(result: DataFrame | int | None) -> str:
        """A result as JSON: rows, rows_affected or ok."""

        def plain(v):
            if isinstance(v, bytes | bytearray):
                return base64.b64encode(v).decode()
            if isinstance(v, datetime.datetime | datetime.date):
                return v.isoformat()
            return str(v) if isinstance(v, Decimal) else v

        if isinstance(result, DataFrame):
            return json.dumps({"columns": result.columns, "rows": [{k: plain(v) for k, v in zip(result.columns, r)} for r in result.collect()]}, ensure_ascii=False)
        return json.dumps({"ok": True} if result is None else {"rows_affected": result})

    @staticmethod
    def to_text(result: DataFrame | int | None) -> str:
        """A result as a text table."""
        if not isinstance(result, DataFrame):
            return "OK" if result is None else f"{result} row(s) affected"
        rows = [["NULL" if v is None else str(v) for v in r] for r in result.collect()]
        width = [max(map(len, c)) for c in zip(result.columns, *rows)]
        line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        show = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, width)) + "|"
        return "\n".join([line, show(result.columns), line, *map(show, rows), line, f"{len(rows)} row(s)"])


__all__ = ["Engine", "Prepared"]
