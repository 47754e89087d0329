import pytest

from quernel.errors import ParseError
from quernel.sql.parser import parse
from quernel.sql.tree import CreateFulltext, Explain, Insert, Select, SetQuery, Transaction


def where(text):
    return parse(f"SELECT * FROM t WHERE {text}").where


def test_precedence():
    a, b, c = (("col", None, x) for x in "abc")
    assert where("a OR b AND NOT c") == ("bin", "OR", a, ("bin", "AND", b, ("not", c)))
    assert where("a + b * c = 1") == ("bin", "=", ("bin", "+", a, ("bin", "*", b, c)), ("lit", "int", 1))
    assert where("NOT a = 1") == ("not", ("bin", "=", a, ("lit", "int", 1)))
    assert where("a BETWEEN 1 AND b + 1 AND c") == ("bin", "AND", ("between", a, ("lit", "int", 1), ("bin", "+", b, ("lit", "int", 1)), False), c)


def test_literals():
    items = [e for e, _ in parse("SELECT 'it''s', X'4a', -5, 1.5, NULL, -9223372036854775808").items]
    assert items == [("lit", "str", "it's"), ("lit", "bin", b"J"), ("lit", "int", -5), ("lit", "float", 1.5), ("lit", "null", None), ("lit", "int", -(1 << 63))]


def test_statements():
    q = parse("SELECT a AS x FROM t u JOIN v ON u.a = v.b GROUP BY a HAVING COUNT(*) > 1 ORDER BY a DESC LIMIT 3 OFFSET 4;")
    assert isinstance(q, Select) and q.table.label == "u" and q.joins[0].kind == "inner" and (q.limit, q.offset) == (3, 4)
    q = parse("SELECT a FROM t UNION ALL SELECT b FROM u ORDER BY a LIMIT 2")
    assert isinstance(q, SetQuery) and q.limit == 2 and q.rest[0][0] and q.rest[0][1].limit is None
    assert isinstance(parse("INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = a + 1"), Insert)
    assert parse("REPLACE INTO t (a) VALUES (?, ?)").params == 2
    assert parse("CREATE FULLTEXT INDEX i ON t(c) OPTIONS (stop_filter=on)").options["stop_filter"] is True
    assert isinstance(parse("CREATE FULLTEXT INDEX i ON t(c)"), CreateFulltext)
    assert isinstance(parse("EXPLAIN DELETE FROM t WHERE a = 1"), Explain)
    assert parse("ROLLBACK TO s") == Transaction("ROLLBACK TO", "s")


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT * WHERE 1", "SELECT a FROM t;;", "SELECT a b c FROM t", "CREATE TABLE t (a DECIMAL(29,2))", "SELECT X'4'", "SELECT 'a", "INSERT INTO t VALUES", "SET nothing = 1", "SELECT a FROM t JOIN u", "SELECT @a"])
def test_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)


@pytest.mark.parametrize("name", ["count", "min", "key", "column", "rename", "to", "analyze"])
def test_words_as_names(name):
    assert parse(f"SELECT {name} FROM t").items[0][0] == ("col", None, name)
