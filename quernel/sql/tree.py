"""Statements as dataclasses; expressions as tuples whose first item names the node.

("lit", kind, value)  ("col", qualifier, name)  ("param", i)  ("default",)  ("star",)
("neg", e)  ("not", e)  ("bin", op, a, b)  ("like", e, pattern, negated)  ("regexp", e, pattern)
("in", e, (e, ...), negated)  ("insub", e, Select, negated)  ("exists", Select, negated)  ("sub", Select)
("between", e, lo, hi, negated)  ("isnull", e, negated)  ("case", operand, ((when, then), ...), other)
("func", name, (args, ...), distinct)  ("cast", e, Type)  ("match", column, query, mode)  ("snippet", column, query, pre, post, n)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

Expr = tuple

AGGREGATES = frozenset(["COUNT", "SUM", "AVG", "MIN", "MAX"])


@dataclass(frozen=True)
class Type:
    """A declared type: name, and length or precision and scale."""

    name: str
    a: int | None = None
    b: int | None = None

    def __str__(self) -> str:
        if self.name == "DECIMAL":
            return f"DECIMAL({self.a},{self.b})"
        return self.name if self.a is None else f"{self.name}({self.a})"


@dataclass
class ColumnSpec:
    name: str
    type: Type
    primary: bool = False
    unique: bool = False
    nullable: bool = True
    auto_increment: bool = False
    default: Expr | None = None
    check: Expr | None = None
    check_text: str | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    parents: list[str]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass
class TableRef:
    name: str
    alias: str | None = None
    hints: list[tuple[str, list[str]]] = field(default_factory=list)

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass
class Join:
    kind: str
    table: TableRef
    on: Expr | None


@dataclass
class OrderItem:
    expr: Expr
    descending: bool = False


@dataclass(eq=False)
class Select:
    items: list[tuple[Expr, str | None]]
    distinct: bool = False
    table: TableRef | None = None
    joins: list[Join] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[OrderItem] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass(eq=False)
class SetQuery:
    first: Select
    rest: list[tuple[bool, Select]]
    order: list[OrderItem] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnSpec]
    primary: list[str] = field(default_factory=list)
    uniques: list[tuple[str | None, list[str]]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    if_not_exists: bool = False


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    if_not_exists: bool = False


@dataclass
class CreateFulltext:
    name: str
    table: str
    column: str
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class DropTable:
    name: str
    if_exists: bool = False


@dataclass
class DropIndex:
    name: str
    if_exists: bool = False


@dataclass
class AlterTable:
    table: str
    action: str
    column: ColumnSpec | None = None
    old: str | None = None
    foreign: ForeignKey | None = None
    names: list[str] = field(default_factory=list)


@dataclass
class RenameTable:
    old: str
    new: str


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Expr]]
    replace: bool = False
    on_duplicate: list[tuple[str, Expr]] | None = None


@dataclass
class Update:
    table: TableRef
    sets: list[tuple[str, Expr]]
    where: Expr | None = None


@dataclass
class Delete:
    table: TableRef
    where: Expr | None = None


@dataclass
class Show:
    what: str
    name: str | None = None


@dataclass
class Transaction:
    verb: str
    name: str | None = None


@dataclass
class Explain:
    statement: Any


@dataclass
class Analyze:
    table: str


@dataclass
class SetOption:
    name: str
    value: int


def walk(e: Any) -> Iterator[Expr]:
    """An expression and all its parts, not going into subqueries."""
    if isinstance(e, tuple):
        if e and isinstance(e[0], str):
            yield e
        for x in e:
            yield from walk(x)


def rewrite(e: Any, change: Callable[[Expr], Expr | None]) -> Any:
    """The expression with the topmost parts replaced for which change returns something."""
    if not isinstance(e, tuple):
        return e
    if e and isinstance(e[0], str) and (new := change(e)) is not None:
        return new
    return tuple(rewrite(x, change) for x in e)


def has_aggregate(e: Any) -> bool:
    return any(x[0] == "func" and x[1] in AGGREGATES for x in walk(e))
