"""Recursive-descent parser of the dialect.

Precedence, low to high: OR, AND, NOT, one comparison (= <> != < > <= >= IS LIKE IN BETWEEN REGEXP), + and -, * / %, unary -,
primary.  One statement per call, with an optional semicolon.
"""

from __future__ import annotations

from ..errors import ParseError
from .lexer import Token, tokenize
from .tree import (
    AlterTable, Analyze, ColumnSpec, CreateFulltext, CreateIndex, CreateTable, Delete, DropIndex, DropTable, Explain, Expr, ForeignKey,
    Insert, Join, OrderItem, RenameTable, Select, SetOption, SetQuery, Show, TableRef, Transaction, Type, Update,
)

#: words that end a clause, so they can't be an alias without AS
_RESERVED = frozenset(
    """SELECT FROM WHERE GROUP ORDER HAVING LIMIT OFFSET UNION JOIN INNER LEFT RIGHT CROSS OUTER ON SET VALUES AND OR NOT AS IN LIKE BETWEEN IS
    REGEXP CASE WHEN THEN ELSE END FORCE USE IGNORE INSERT UPDATE DELETE CREATE DROP ALTER DISTINCT BY""".split()
)
_INTS = {"TINYINT": "TINYINT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "SMALLINT": "SMALLINT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT"}
_TYPES = _INTS | {t: t for t in ("FLOAT", "DOUBLE", "DATE", "DATETIME", "TIMESTAMP", "TEXT", "JSONB", "UUID")} | {"JSON": "JSONB"}
_OPTIONS = ("checkpoint_tx_threshold", "checkpoint_wal_bytes_threshold", "checkpoint_interval_ms")


def parse(sql: str):
    """The statement that sql is."""
    p = _Parser(sql)
    out = p.statement()
    p.accept(";")
    if p.token.kind != "end":
        raise ParseError(f"unexpected {p.token.value!r} after the statement")
    out_params = p.params
    try:
        out.params = out_params
    except AttributeError:
        pass
    return out


class _Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i, self.params = sql, tokenize(sql), 0, 0

    @property
    def token(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def word(self, t: Token | None = None) -> str | None:
        t = t or self.token
        return t.value.upper() if t.kind == "word" else None

    def accept(self, *names: str) -> bool:
        """Take these words or signs if they come next."""
        for k, n in enumerate(names):
            t = self.peek(k)
            if not (t.kind == "word" and t.value.upper() == n or t.kind == "op" and t.value == n):
                return False
        self.i += len(names)
        return True

    def expect(self, *names: str) -> None:
        if not self.accept(*names):
            raise ParseError(f"expected {' '.join(names)} but found {self.token.value!r} at {self.token.at}")

    def name(self) -> str:
        t = self.token
        if t.kind != "word":
            raise ParseError(f"expected a name but found {t.value!r} at {t.at}")
        self.i += 1
        return t.value

    def names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out

    def integer(self) -> int:
        t = self.token
        if t.kind != "int":
            raise ParseError(f"expected an integer but found {t.value!r} at {t.at}")
        self.i += 1
        return t.value

    def string(self) -> str:
        t = self.token
        if t.kind != "string":
            raise ParseError(f"expected a string but found {t.value!r} at {t.at}")
        self.i += 1
        return t.value

    # statements

    def statement(self):
        w = self.word()
        method = getattr(self, f"_{w.lower()}", None) if w in ("CREATE", "DROP", "ALTER", "RENAME", "INSERT", "REPLACE", "UPDATE", "DELETE", "SHOW", "SET", "ROLLBACK", "RELEASE") else None
        if method:
            self.i += 1
            return method()
        if w == "SELECT":
            return self.query()
        if self.accept("DESCRIBE") or self.accept("DESC"):
            return Show("describe", self.name())
        if self.accept("EXPLAIN"):
            return Explain(self.statement())
        if self.accept("ANALYZE", "TABLE"):
            return Analyze(self.name())
        for verb in ("BEGIN", "COMMIT"):
            if self.accept(verb):
                return Transaction(verb)
        if self.accept("SAVEPOINT"):
            return Transaction("SAVEPOINT", self.name())
        raise ParseError(f"unknown statement at {self.token.value!r}")

    def _rollback(self):
        if self.accept("TO"):
            self.accept("SAVEPOINT")
            return Transaction("ROLLBACK TO", self.name())
        return Transaction("ROLLBACK")

    def _release(self):
        self.expect("SAVEPOINT")
        return Transaction("RELEASE", self.name())

    def _set(self):
        name = self.name().lower()
        if name not in _OPTIONS:
            raise ParseError(f"unknown option {name!r}")
        self.expect("=")
        return SetOption(name, self.integer())

    def _show(self):
        if self.accept("TABLES"):
            return Show("tables")
        if self.accept("CREATE", "TABLE"):
            return Show("create", self.name())
        for what in ("CHECKPOINT", "DATABASE"):
            if self.accept(what, "STATS"):
                return Show(what.lower())
        raise ParseError(f"can't show {self.token.value!r}")

    def _if_exists(self, negated: bool = False) -> bool:
        return self.accept("IF", "NOT", "EXISTS") if negated else self.accept("IF", "EXISTS")

    def _drop(self):
        if self.accept("TABLE"):
            there = self._if_exists()
            return DropTable(self.name(), there)
        self.expect("INDEX")
        there = self._if_exists()
        return DropIndex(self.name(), there)

    def _rename(self):
        self.expect("TABLE")
        old = self.name()
        self.expect("TO")
        return RenameTable(old, self.name())

    def _create(self):
        if self.accept("TABLE"):
            return self._create_table()
        if self.accept("FULLTEXT"):
            self.expect("INDEX")
            return self._create_fulltext()
        unique = self.accept("UNIQUE")
        self.expect("INDEX")
        there = self._if_exists(True)
        name = self.name()
        self.expect("ON")
        return CreateIndex(name, self.name(), self.names(), unique, there)

    def _create_fulltext(self):
        name = self.name()
        self.expect("ON")
        table = self.name()
        columns = self.names()
        if len(columns) != 1:
            raise ParseError("a full-text index has one column")
        options = {"parser": "ngram", "n": 2, "normalize": "nfkc", "stop_filter": False, "stop_df_ratio_ppm": 200_000}
        if self.accept("WITH"):
            self.expect("PARSER")
            options["parser"] = self.name()
        if self.accept("OPTIONS"):
            self.expect("(")
            while True:
                key = self.name()
                self.expect("=")
                t = self.token
                self.i += 1
                if key == "stop_filter":
                    known = {"on": True, "true": True, "1": True, "off": False, "false": False, "0": False}
                    text = str(t.value).lower()
                    if text not in known and t.kind != "int":
                        raise ParseError(f"bad stop_filter {t.value!r}")
                    options[key] = known.get(text, t.value != 0)
                elif key in ("n", "stop_df_ratio_ppm"):
                    if t.kind != "int" or t.value >= 1 << 32:
                        raise ParseError(f"bad {key} {t.value!r}")
                    options[key] = t.value
                elif key == "normalize":
                    options[key] = str(t.value)
                else:
                    raise ParseError(f"unknown option {key!r}")
                if not self.accept(","):
                    break
            self.expect(")")
        return CreateFulltext(name, table, columns[0], options)

    def _create_table(self):
        there = self._if_exists(True)
        out = CreateTable(self.name(), [], if_not_exists=there)
        self.expect("(")
        while True:
            if self.accept("CONSTRAINT"):
                self.name()
            if self.word() == "PRIMARY":
                self.expect("PRIMARY", "KEY")
                out.primary = self.names()
            elif self.word() == "UNIQUE" and (self.peek().value == "(" or self.peek(2).value == "("):
                self.i += 1
                label = self.name() if self.token.kind == "word" else None
                out.uniques.append((label, self.names()))
            elif self.word() == "FOREIGN":
                out.foreign.append(self._foreign())
            else:
                out.columns.append(self._column())
            if not self.accept(","):
                break
        self.expect(")")
        return out

    def _foreign(self) -> ForeignKey:
        self.expect("FOREIGN", "KEY")
        columns = self.names()
        self.expect("REFERENCES")
        out = ForeignKey(columns, self.name(), self.names())
        while self.accept("ON"):
            which = self.name().upper()
            action = "CASCADE" if self.accept("CASCADE") else "SET NULL" if self.accept("SET", "NULL") else "RESTRICT" if self.accept("RESTRICT") or self.accept("NO", "ACTION") else None
            if action is None or which not in ("DELETE", "UPDATE"):
                raise ParseError(f"bad foreign key action at {self.token.value!r}")
            setattr(out, f"on_{which.lower()}", action)
        return out

    def type(self) -> Type:
        w = self.name().upper()
        if w in ("VARCHAR", "VARBINARY"):
            n = None
            if self.accept("("):
                n = self.integer()
                self.expect(")")
            return Type(w, n)
        if w in ("DECIMAL", "NUMERIC"):
            p, s = 10, 0
            if self.accept("("):
                p = self.integer()
                s = self.integer() if self.accept(",") else 0
                self.expect(")")
            if not 1 <= p <= 28 or s > p:
                raise ParseError(f"bad precision DECIMAL({p},{s})")
            return Type("DECIMAL", p, s)
        if w not in _TYPES:
            raise ParseError(f"unknown type {w}")
        return Type(_TYPES[w])

    def _column(self) -> ColumnSpec:
        c = ColumnSpec(self.name(), self.type())
        while True:
            if self.accept("PRIMARY", "KEY"):
                c.primary, c.nullable = True, False
            elif self.accept("UNIQUE"):
                c.unique = True
            elif self.accept("NOT", "NULL"):
                c.nullable = False
            elif self.accept("NULL"):
                pass
            elif self.accept("AUTO_INCREMENT"):
                c.auto_increment = True
            elif self.accept("DEFAULT"):
                c.default = self.primary() if self.token.value != "-" else self.unary()
            elif self.word() == "CHECK" or self.word() == "CONSTRAINT":
                if self.accept("CONSTRAINT"):
                    self.name()
                self.expect("CHECK")
                a = self.token.at
                self.expect("(")
                c.check = self.expr()
                c.check_text = self.sql[a + 1 : self.token.at].strip()
                self.expect(")")
            else:
                return c

    def _alter(self):
        self.expect("TABLE")
        table = self.name()
        if self.accept("ADD"):
            if self.accept("CONSTRAINT"):
                self.name()
            if self.word() == "FOREIGN":
                return AlterTable(table, "add foreign", foreign=self._foreign())
            if self.word() == "COLUMN" and self.peek(1).kind == "word" and self.peek(2).kind == "word":
                self.accept("COLUMN")
            return AlterTable(table, "add", self._column())
        if self.accept("DROP"):
            if self.accept("FOREIGN", "KEY"):
                return AlterTable(table, "drop foreign", names=self.names())
            if self.word() == "COLUMN" and self.peek(1).kind == "word":
                self.accept("COLUMN")
            return AlterTable(table, "drop", old=self.name())
        if self.accept("MODIFY"):
            if self.word() == "COLUMN" and self.peek(2).kind == "word":
                self.accept("COLUMN")
            return AlterTable(table, "modify", self._column())
        self.expect("CHANGE")
        if self.word() == "COLUMN" and self.peek(3).kind == "word":
            self.accept("COLUMN")
        old = self.name()
        return AlterTable(table, "change", self._column(), old=old)

    def _insert(self):
        return self._rows(False)

    def _replace(self):
        return self._rows(True)

    def _rows(self, replace: bool):
        self.expect("INTO")
        table = self.name()
        columns = self.names() if self.token.value == "(" else None
        self.expect("VALUES")
        rows = []
        while True:
            self.expect("(")
            row = [self.expr()]
            while self.accept(","):
                row.append(self.expr())
            self.expect(")")
            rows.append(row)
            if not self.accept(","):
                break
        again = None
        if not replace and self.accept("ON", "DUPLICATE", "KEY", "UPDATE"):
            again = self._sets()
        return Insert(table, columns, rows, replace, again)

    def _sets(self) -> list[tuple[str, Expr]]:
        out = []
        while True:
            name = self.name()
            self.expect("=")
            out.append((name, self.expr()))
            if not self.accept(","):
                return out

    def _update(self):
        table = TableRef(self.name(), hints=self._hints())
        self.expect("SET")
        sets = self._sets()
        return Update(table, sets, self.expr() if self.accept("WHERE") else None)

    def _delete(self):
        self.expect("FROM")
        table = TableRef(self.name(), hints=self._hints())
        return Delete(table, self.expr() if self.accept("WHERE") else None)

    # queries

    def query(self):
        first, rest = self.select(), []
        while self.accept("UNION"):
            rest.append((self.accept("ALL"), self.select()))
        if not rest:
            return first
        out = SetQuery(first, rest)
        # a trailing ORDER BY, LIMIT or OFFSET belongs to the whole
        for s in (first, *(s for _, s in rest)):
            out.order, s.order = s.order or out.order, []
            out.limit, s.limit = (s.limit if s.limit is not None else out.limit), None
            out.offset, s.offset = (s.offset if s.offset is not None else out.offset), None
        return out

    def _hints(self) -> list[tuple[str, list[str]]]:
        out = []
        while self.word() in ("FORCE", "USE", "IGNORE") and self.word(self.peek()) == "INDEX":
            kind = self.word()
            self.i += 2
            out.append((kind, self.names()))
        return out

    def _table(self) -> TableRef:
        name, alias = self.name(), None
        if self.accept("AS"):
            alias = self.name()
        elif self.token.kind == "word" and self.word() not in _RESERVED:
            alias = self.name()
        return TableRef(name, alias, self._hints())

    def select(self) -> Select:
        self.expect("SELECT")
        out = Select([], self.accept("DISTINCT"))
        if self.accept("*"):
            out.items = [(("star",), None)]
        else:
            while True:
                out.items.append(self._item())
                if not self.accept(","):
                    break
        if self.accept("FROM"):
            out.table = self._table()
            while (join := self._join()) is not None:
                out.joins.append(join)
        elif out.items[0][0] == ("star",):
            raise ParseError("* needs a FROM clause")
        if self.accept("WHERE"):
            out.where = self.expr()
        if self.accept("GROUP", "BY"):
            out.group = self._list()
        if self.accept("HAVING"):
            out.having = self.expr()
        if self.accept("ORDER", "BY"):
            while True:
                e = self.expr()
                out.order.append(OrderItem(e, self.accept("DESC") or (self.accept("ASC") and False)))
                if not self.accept(","):
                    break
        if self.accept("LIMIT"):
            out.limit = self.integer()
        if self.accept("OFFSET"):
            out.offset = self.integer()
        return out

    def _item(self) -> tuple[Expr, str | None]:
        if self.token.kind == "word" and self.peek().value == "." and self.peek(2).value == "*":
            q = self.name()
            self.i += 2
            return ("star", q), None
        e = self.expr()
        return e, self.name() if self.accept("AS") else None

    def _join(self) -> Join | None:
        kind = None
        if self.accept("CROSS", "JOIN"):
            return Join("cross", self._table(), None)
        if self.accept("JOIN") or self.accept("INNER", "JOIN"):
            kind = "inner"
        for side in ("LEFT", "RIGHT"):
            if not kind and (self.accept(side, "OUTER", "JOIN") or self.accept(side, "JOIN")):
                kind = side.lower()
        if not kind:
            return None
        table = self._table()
        self.expect("ON")
        return Join(kind, table, self.expr())

    def _list(self) -> list[Expr]:
        out = [self.expr()]
        while self.accept(","):
            out.append(self.expr())
        return out

    # expressions

    def expr(self) -> Expr:
        out = self._and()
        while self.accept("OR"):
            out = ("bin", "OR", out, self._and())
        return out

    def _and(self) -> Expr:
        out = self._not()
        while self.accept("AND"):
            out = ("bin", "AND", out, self._not())
        return out

    def _not(self) -> Expr:
        if self.word() == "NOT" and self.word(self.peek()) != "EXISTS":
            self.i += 1
            return ("not", self._not())
        return self._comparison()

    def _comparison(self) -> Expr:
        if self.accept("NOT", "EXISTS"):
            return ("exists", self._subquery(), True)
        if self.accept("EXISTS"):
            return ("exists", self._subquery(), False)
        left = self._sum()
        t = self.token
        if t.kind == "op" and t.value in ("=", "<>", "!=", "<", ">", "<=", ">="):
            self.i += 1
            return ("bin", "<>" if t.value == "!=" else t.value, left, self._sum())
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.expect("NULL")
            return ("isnull", left, negated)
        negated = self.word() == "NOT" and self.word(self.peek()) in ("LIKE", "IN", "BETWEEN", "REGEXP")
        if negated:
            self.i += 1
        if self.accept("LIKE"):
            return ("like", left, self._sum(), negated)
        if self.accept("REGEXP"):
            e = ("regexp", left, self._sum())
            return ("not", e) if negated else e
        if self.accept("BETWEEN"):
            low = self._sum()
            self.expect("AND")
            return ("between", left, low, self._sum(), negated)
        if self.accept("IN"):
            if self.word(self.peek()) == "SELECT":
                return ("insub", left, self._subquery(), negated)
            self.expect("(")
            items = self._list()
            self.expect(")")
            return ("in", left, tuple(items), negated)
        return left

    def _subquery(self):
        self.expect("(")
        out = self.query()
        self.expect(")")
        return out

    def _sum(self) -> Expr:
        out = self._product()
        while self.token.kind == "op" and self.token.value in ("+", "-"):
            op = self.token.value
            self.i += 1
            out = ("bin", op, out, self._product())
        return out

    def _product(self) -> Expr:
        out = self.unary()
        while self.token.kind == "op" and self.token.value in ("*", "/", "%"):
            op = self.token.value
            self.i += 1
            out = ("bin", op, out, self.unary())
        return out

    def unary(self) -> Expr:
        if self.accept("-"):
            e = self.unary()
            if e[0] == "lit" and e[1] in ("int", "float"):
                return ("lit", e[1], -e[2])
            return ("neg", e)
        return self.primary()

    def primary(self) -> Expr:
        t = self.token
        if t.kind in ("int", "float", "string", "hex"):
            self.i += 1
            if t.kind == "int" and t.value > 1 << 63:
                raise ParseError(f"integer {t.value} is too large")
            return ("lit", {"string": "str", "hex": "bin"}.get(t.kind, t.kind), t.value)
        if self.accept("?"):
            self.params += 1
            return ("param", self.params - 1)
        if t.value == "(":
            if self.word(self.peek()) == "SELECT":
                return ("sub", self._subquery())
            self.i += 1
            e = self.expr()
            self.expect(")")
            return e
        if t.kind != "word":
            raise ParseError(f"unexpected {t.value!r} at {t.at}")
        w, call = t.value.upper(), self.peek().value == "("
        if w == "NULL":
            self.i += 1
            return ("lit", "null", None)
        if w == "DEFAULT" and not call:
            self.i += 1
            return ("default",)
        if w == "CASE":
            return self._case()
        if w == "CURRENT_TIMESTAMP" and not call:
            self.i += 1
            return ("func", "NOW", (), False)
        if call:
            return self._call(w)
        if w in _RESERVED:
            raise ParseError(f"unexpected {t.value!r} at {t.at}")
        self.i += 1
        if self.token.value == "." and self.peek().kind == "word":
            self.i += 1
            return ("col", t.value, self.name())
        return ("col", None, t.value)

    def _case(self) -> Expr:
        self.expect("CASE")
        operand = None if self.word() == "WHEN" else self.expr()
        whens = []
        while self.accept("WHEN"):
            cond = self.expr()
            self.expect("THEN")
            whens.append((cond, self.expr()))
        if not whens:
            raise ParseError("CASE needs a WHEN")
        other = self.expr() if self.accept("ELSE") else ("lit", "null", None)
        self.expect("END")
        return ("case", operand, tuple(whens), other)

    def _call(self, name: str) -> Expr:
        self.i += 2
        if name == "CAST":
            e = self.expr()
            self.expect("AS")
            kind = self.type()
            self.expect(")")
            return ("cast", e, kind)
        if name == "MATCH":
            column = self.name()
            self.expect(")")
            self.expect("AGAINST")
            self.expect("(")
            query, mode = self.string(), "natural"
            if self.accept("IN"):
                if self.accept("BOOLEAN", "MODE"):
                    mode = "boolean"
                else:
                    self.expect("NATURAL", "LANGUAGE", "MODE")
            self.expect(")")
            return ("match", column, query, mode)
        if name == "FTS_SNIPPET":
            column = self.name()
            args = []
            for take in (self.string, self.string, self.string, self.integer):
                self.expect(",")
                args.append(take())
            self.expect(")")
            return ("snippet", column, *args)
        if name == "COUNT" and self.accept("*"):
            self.expect(")")
            return ("func", "COUNT", (("star",),), False)
        distinct = self.accept("DISTINCT")
        args = () if self.token.value == ")" else tuple(self._list())
        self.expect(")")
        return ("func", name, args, distinct)
