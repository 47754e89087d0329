"""Table definitions, and the catalog as one JSON document that is replaced in one step."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import SchemaError
from ..sql.parser import _Parser
from ..sql.tree import ColumnSpec, Expr, ForeignKey, Type

ROWID = "_rowid"
_SPARK = {
    "TINYINT": T.ByteType(), "BOOLEAN": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "VARBINARY": T.BinaryType(),
}


def spark_type(t: Type) -> T.DataType:
    return T.DecimalType(t.a, t.b) if t.name == "DECIMAL" else _SPARK.get(t.name, T.StringType())


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    fulltext: dict | None = None
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    bins: list[int] = field(default_factory=list)


@dataclass
class Column:
    name: str
    type: Type
    nullable: bool = True
    unique: bool = False
    auto_increment: bool = False
    default: list | None = None
    check: str | None = None
    hidden: bool = False

    @classmethod
    def of(cls, c: ColumnSpec) -> Column:
        default = None
        if c.default is not None and c.default[0] == "lit":
            kind, value = c.default[1:]
            default = [kind, value.hex() if kind == "bin" else value]
        return cls(c.name, c.type, c.nullable, c.unique, c.auto_increment, default, c.check_text)

    @property
    def default_expr(self) -> Expr:
        if self.default is None:
            return ("lit", "null", None)
        kind, value = self.default
        return ("lit", kind, bytes.fromhex(value) if kind == "bin" else value)

    @property
    def check_expr(self) -> Expr:
        return _Parser(self.check).expr()


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary: list[str]
    foreign: list[ForeignKey] = field(default_factory=list)
    counter: int = 0
    #: folders of the current snapshot: an insert adds one, other changes replace them
    parts: list[str] = field(default_factory=list)
    #: the columns that the folders hold; later ones have their default
    stored: list[str] = field(default_factory=list)
    analyzed: int = 0
    #: rows from outside, read only
    source: Callable[[], DataFrame] | None = None

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"unknown column {self.name}.{name}")

    @property
    def visible(self) -> list[str]:
        return [c.name for c in self.columns if not c.hidden]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.columns])

    def rows(self, spark: SparkSession) -> DataFrame:
        if self.source is not None:
            return self.source()
        kept = T.StructType([f for f in self.schema() if f.name in self.stored])
        df = spark.read.schema(kept).parquet(*self.parts) if self.parts else spark.createDataFrame([], kept)
        missing = [c for c in self.columns if c.name not in self.stored]
        if not missing:
            return df.select(*[c.name for c in self.columns])
        from ..plans.expressions import compile_expr, Scope

        made = {c.name: F.expr(compile_expr(c.default_expr, Scope())[0]).cast(spark_type(c.type)) for c in missing}
        return df.select(*[made[c.name].alias(c.name) if c.name in made else F.col(c.name) for c in self.columns])


class Catalog:
    """Tables and indexes by name.  A copy is a transaction's own view; snapshots are shared, since they never change."""

    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}
        self.version = 0

    def copy(self) -> Catalog:
        out = Catalog()
        out.version = self.version
        out.tables = {k: copy.deepcopy(t) if t.source is None else t for k, t in self.tables.items()}
        out.indexes = copy.deepcopy(self.indexes)
        return out

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise SchemaError(f"table {name} not found")
        return self.tables[name]

    def of_table(self, name: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == name]

    def uniques(self, table: Table) -> list[list[str]]:
        """Unique column lists, the primary key first."""
        out = [table.primary]
        for i in self.of_table(table.name):
            if i.unique and i.columns not in out:
                out.append(i.columns)
        return out

    def children(self, name: str) -> list[tuple[Table, ForeignKey]]:
        return [(t, fk) for t in self.tables.values() for fk in t.foreign if fk.table == name]

    def dumps(self) -> str:
        def plain(t: Table) -> dict:
            d = asdict(t)
            d.pop("source")
            return d

        return json.dumps({"version": self.version, "tables": [plain(t) for t in self.tables.values() if t.source is None], "indexes": [asdict(i) for i in self.indexes.values() if self.tables[i.table].source is None]})

    @classmethod
    def loads(cls, text: str) -> Catalog:
        d, out = json.loads(text), cls()
        out.version = d["version"]
        for t in d["tables"]:
            t["columns"] = [Column(**{**c, "type": Type(**c["type"])}) for c in t["columns"]]
            t["foreign"] = [ForeignKey(**f) for f in t["foreign"]]
            out.tables[t["name"]] = Table(**t)
        out.indexes = {i["name"]: Index(**i) for i in d["indexes"]}
        return out
