"""Statements end to end, on small tables."""

from decimal import Decimal

import pytest

from quernel.engine import Engine
from quernel.errors import CheckViolation, EngineError, ExecutionError, ForeignKeyViolation, LockError, ParseError, SchemaError, TransactionError, UniqueViolation


@pytest.fixture
def e(spark):
    return Engine(spark)


def run(e, *statements):
    for s in statements[:-1]:
        e.execute(s)
    out = e.execute(statements[-1])
    return [tuple(r) for r in out.collect()] if hasattr(out, "collect") else out


@pytest.fixture(scope="module")
def orders(spark):
    e = Engine(spark)
    run(
        e,
        "CREATE TABLE orders (id BIGINT PRIMARY KEY, category VARCHAR, amount INT, status VARCHAR)",
        "INSERT INTO orders VALUES (1,'A',100,'active'),(2,'B',200,'active'),(3,'A',150,'inactive'),(4,'B',300,'active'),(5,'A',250,'active')",
        "CREATE TABLE t (id BIGINT PRIMARY KEY, g VARCHAR, val INT, d DECIMAL(10,2), s VARCHAR)",
        "INSERT INTO t VALUES (1,'A',10,'10.50','hello'),(2,NULL,NULL,'20.25','héllo'),(3,'A',30,'30.75','  hello  '),(4,NULL,4,NULL,'')",
        "CREATE TABLE users (id BIGINT PRIMARY KEY, name VARCHAR)",
        "INSERT INTO users VALUES (1,'Alice'),(2,'Bob'),(3,'Charlie')",
        "CREATE TABLE buys (id BIGINT PRIMARY KEY, user_id BIGINT, product VARCHAR)",
        "INSERT INTO buys VALUES (10,1,'Widget'),(11,1,'Gadget'),(12,2,'Doohickey'),(13,NULL,'Lost')",
    )
    return e


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT COUNT(*), SUM(amount), AVG(amount), MIN(amount), MAX(amount) FROM orders", [(5, 1000, 200, 100, 300)]),
        ("SELECT category, SUM(amount) AS s, COUNT(*) AS n FROM orders GROUP BY category ORDER BY category", [("A", 500, 3), ("B", 500, 2)]),
        ("SELECT category, status, COUNT(*) AS n FROM orders GROUP BY category, status HAVING COUNT(*) > 1 ORDER BY n DESC, category", [("A", "active", 2), ("B", "active", 2)]),
        ("SELECT COUNT(DISTINCT category), COUNT(DISTINCT status) FROM orders", [(2, 2)]),
        ("SELECT DISTINCT category FROM orders ORDER BY category DESC", [("B",), ("A",)]),
        ("SELECT COUNT(val), COUNT(*), SUM(val), AVG(val) FROM t", [(3, 4, 44, 14)]),
        ("SELECT g, SUM(val) AS s FROM t GROUP BY g ORDER BY g", [(None, 4), ("A", 40)]),
        ("SELECT SUM(d), MIN(d), MAX(d) FROM t", [(Decimal("61.50"), Decimal("10.50"), Decimal("30.75"))]),
        ("SELECT SUM(val) FROM t WHERE val > 1000", [(None,)]),
        ("SELECT g, COUNT(*) FROM t WHERE val > 1000 GROUP BY g", []),
        ("SELECT id FROM t ORDER BY val", [(2,), (4,), (1,), (3,)]),
        ("SELECT id FROM t ORDER BY val DESC LIMIT 2", [(3,), (1,)]),
        ("SELECT id FROM t LIMIT 2 OFFSET 1", [(2,), (3,)]),
        ("SELECT val BETWEEN NULL AND 1, val IN (10, NULL), val NOT IN (10, NULL) FROM t WHERE id = 3", [(None, None, None)]),
        ("SELECT LENGTH(s), CHAR_LENGTH(s), TRIM(s), REVERSE(s) FROM t WHERE id = 2", [(6, 5, "héllo", "olléh")]),
        ("SELECT '5' = 5, '5' <> 5, '5' < 5, NULL = NULL", [(0, 1, 0, None)]),
        ("SELECT 7 / 2, -7 / 2, -7 % 3, 7.0 / 2, 2 * 3 + 1", [(3, -3, -1, 3.5, 7)]),
        ("SELECT CAST(300 AS TINYINT), CAST(2.9 AS INT), CAST('2.345' AS DECIMAL(5,2)), CAST(1.0 AS VARCHAR), CONCAT(1.5, 'x')", [(300, 2, Decimal("2.34"), "1", "1.5x")]),
        ("SELECT IF(0, 'a', 'b'), IF('', 1, 2), CASE 1 WHEN 2 THEN 'x' END, NULLIF(1, 1), IFNULL(NULL, 3)", [("b", 2, None, None, 3)]),
        ("SELECT 'a%b' LIKE 'a\\%b', 'ab' LIKE 'a_', 5 LIKE '5', 'A' LIKE 'a'", [(0, 1, 0, 0)]),
        ("SELECT ROUND(2.5), ROUND(-2.5), ROUND(1.005, 2), CEIL(-1.5), POWER(2, 10), POWER(2, -1), MOD(7, 3)", [(3.0, -3.0, 1.0, -1.0, 1024, 0, 1)]),
        ("SELECT LPAD('hi', 1, '?'), RPAD('hi', 5, 'ab'), INSTR('abc', ''), LOCATE('b', 'abcb', 3), REPEAT('a', -1)", [("h", "hiaba", 1, 4, "")]),
        ("SELECT DATE_FORMAT('2026-02-22 13:04:05', '%Y/%m/%d %H:%i:%s'), DATE_FORMAT('bad', '%Y')", [("2026/02/22 13:04:05", None)]),
        ("SELECT JSON_EXTRACT('{\"a\":{\"b\":[1,\"x\"]}}', '$.a.b[1]'), JSON_REMOVE('{\"a\":1,\"b\":2}', '$.a'), JSON_TYPE('{}'), JSON_CONTAINS('{\"a\":[1,2]}', '[2]')", [('"x"', '{"b":2}', "OBJECT", 1)]),
        ("SELECT name, product FROM users JOIN buys ON users.id = buys.user_id ORDER BY product", [("Bob", "Doohickey"), ("Alice", "Gadget"), ("Alice", "Widget")]),
        ("SELECT u.name, b.product FROM users AS u LEFT JOIN buys b ON u.id = b.user_id WHERE b.product IS NULL", [("Charlie", None)]),
        ("SELECT u.name, b.product FROM users u RIGHT JOIN buys b ON u.id = b.user_id WHERE u.id IS NULL", [(None, "Lost")]),
        ("SELECT COUNT(*) FROM users CROSS JOIN buys", [(12,)]),
        ("SELECT name FROM users WHERE id IN (SELECT user_id FROM buys) ORDER BY name", [("Alice",), ("Bob",)]),
        ("SELECT name FROM users WHERE id NOT IN (SELECT user_id FROM buys)", []),
        ("SELECT name FROM users WHERE EXISTS (SELECT 1 FROM buys WHERE id > 100) OR id = (SELECT MAX(id) FROM users)", [("Charlie",)]),
        ("SELECT id, id IN (SELECT user_id FROM buys), NULLIF(id, 1) NOT IN (SELECT user_id FROM buys WHERE user_id > 1) FROM users ORDER BY id", [(1, 1, None), (2, 1, 0), (3, None, 1)]),
        ("SELECT NULL IN (SELECT id FROM users WHERE id > 9), 1 NOT IN (SELECT id FROM users WHERE id > 9)", [(0, 1)]),
        ("SELECT id FROM users UNION SELECT user_id FROM buys WHERE user_id > 0 ORDER BY id", [(1,), (2,), (3,)]),
        ("SELECT id FROM users UNION ALL SELECT id FROM users ORDER BY id LIMIT 3", [(1,), (1,), (2,)]),
    ],
)
def test_queries(orders, sql, rows):
    assert run(orders, sql) == rows


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT nope FROM users", SchemaError),
        ("SELECT id FROM users JOIN buys ON users.id = buys.user_id", SchemaError),
        ("SELECT * FROM nothing", SchemaError),
        ("SELECT 'a' + 1", ExecutionError),
        ("SELECT NOSUCH(1)", ExecutionError),
        ("SELECT LENGTH()", ParseError),
        ("SELECT id FROM users UNION SELECT id, name FROM users", ExecutionError),
        ("SELECT ?", ExecutionError),
        ("SELECT MATCH(name) AGAINST('x') FROM users", SchemaError),
    ],
)
def test_query_errors(orders, sql, error):
    with pytest.raises(error):
        orders.query(sql)


@pytest.mark.parametrize("sql", ["SELECT 1 / 0", "SELECT 9223372036854775807 + 1", "SELECT CAST('x' AS INT)", "SELECT (SELECT id FROM users)"])
def test_runtime_errors(orders, sql):
    with pytest.raises(Exception):  # noqa: B017  Spark's own
        orders.query(sql).collect()


def test_insert_rules(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY AUTO_INCREMENT, v TINYINT CHECK (v > 0), s VARCHAR(3) NOT NULL DEFAULT 'x', u INT UNIQUE)", "INSERT INTO t (v, u) VALUES (1, NULL), (2, NULL), (NULL, 7)")
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, 1, "x", None), (2, 2, "x", None), (3, None, "x", 7)]
    for sql, error in (("INSERT INTO t (v) VALUES (0)", CheckViolation), ("INSERT INTO t (u) VALUES (7)", UniqueViolation), ("INSERT INTO t (id) VALUES (2)", UniqueViolation), ("INSERT INTO t (u) VALUES (8), (8)", UniqueViolation), ("INSERT INTO t (v) VALUES (1, 2)", ExecutionError), ("INSERT INTO t (q) VALUES (1)", SchemaError)):
        with pytest.raises(error):
            e.execute(sql)
    for sql in ("INSERT INTO t (v) VALUES (128)", "INSERT INTO t (s) VALUES ('long')"):
        with pytest.raises(Exception):  # noqa: B017
            e.execute(sql)
    assert run(e, "SELECT COUNT(*) FROM t") == [(3,)]


def test_upsert_and_replace(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, email VARCHAR, name VARCHAR, UNIQUE (email))", "INSERT INTO t VALUES (1,'a','Alice'),(2,'b','Bob')")
    assert run(e, "INSERT INTO t VALUES (1,'z','new') ON DUPLICATE KEY UPDATE name = CONCAT(name, '!')") == 2
    assert run(e, "INSERT INTO t VALUES (9,'b','new') ON DUPLICATE KEY UPDATE name = 'by email'") == 2
    assert run(e, "INSERT INTO t VALUES (3,'c','C'),(3,'c','D') ON DUPLICATE KEY UPDATE name = 'twice'") == 3
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, "a", "Alice!"), (2, "b", "by email"), (3, "c", "twice")]
    assert run(e, "REPLACE INTO t VALUES (1,'b','both')") == 1
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, "b", "both"), (3, "c", "twice")]


def test_update(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, a INT UNIQUE, b INT NOT NULL)", "INSERT INTO t VALUES (1,10,1),(2,20,2)")
    assert run(e, "UPDATE t SET a = a + 1, b = a WHERE id = 1") == 1
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, 11, 11), (2, 20, 2)]
    assert run(e, "UPDATE t SET id = 5 WHERE id = 2") == 1
    assert run(e, "UPDATE t SET b = 0 WHERE id = 99") == 0
    with pytest.raises(UniqueViolation):
        e.execute("UPDATE t SET a = 1")
    with pytest.raises(CheckViolation):
        e.execute("UPDATE t SET b = NULL")
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, 11, 11), (5, 20, 2)]


def test_composite_keys_and_rowid(e):
    run(e, "CREATE TABLE t (a INT, b INT, v INT, PRIMARY KEY (a, b))", "INSERT INTO t VALUES (1,1,1),(1,2,2)")
    with pytest.raises(UniqueViolation):
        e.execute("INSERT INTO t VALUES (1,2,3)")
    run(e, "CREATE TABLE r (x INT)", "INSERT INTO r VALUES (5),(5)")
    assert run(e, "SELECT * FROM r") == [(5,), (5,)] and run(e, "SELECT _rowid FROM r ORDER BY _rowid") == [(1,), (2,)]


def test_foreign_keys(e):
    run(e, "CREATE TABLE p (id BIGINT PRIMARY KEY)", "CREATE TABLE c (id BIGINT PRIMARY KEY, pid BIGINT, FOREIGN KEY (pid) REFERENCES p(id) ON DELETE CASCADE)", "CREATE TABLE g (id BIGINT PRIMARY KEY, cid BIGINT, FOREIGN KEY (cid) REFERENCES c(id))")
    run(e, "INSERT INTO p VALUES (1),(2)", "INSERT INTO c VALUES (10,1),(20,2)", "INSERT INTO g VALUES (100,10)")
    with pytest.raises(ForeignKeyViolation):
        e.execute("INSERT INTO c VALUES (11,9)")
    with pytest.raises(ForeignKeyViolation):  # the grandchild keeps the cascade from going on
        e.execute("DELETE FROM p WHERE id = 1")
    assert run(e, "DELETE FROM p WHERE id = 2") == 1
    assert run(e, "SELECT id FROM c") == [(10,)]
    with pytest.raises(ForeignKeyViolation):
        e.execute("DROP TABLE p")


def test_cycle_of_cascades(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, up BIGINT, FOREIGN KEY (up) REFERENCES t(id) ON DELETE CASCADE)", "INSERT INTO t VALUES (1,NULL),(2,1),(3,2)", "UPDATE t SET up = 3 WHERE id = 1")
    assert run(e, "DELETE FROM t WHERE id = 2") == 1
    assert run(e, "SELECT COUNT(*) FROM t") == [(0,)]


def test_transactions(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1)")
    with pytest.raises(TransactionError):
        e.execute("BEGIN")
    with pytest.raises(EngineError):
        e.execute("INSERT INTO t VALUES (1)")
    run(e, "SAVEPOINT a", "INSERT INTO t VALUES (2)", "SAVEPOINT b", "INSERT INTO t VALUES (3)", "ROLLBACK TO b")
    assert run(e, "SELECT COUNT(*) FROM t") == [(2,)]
    run(e, "ROLLBACK TO SAVEPOINT a", "COMMIT")
    assert run(e, "SELECT id FROM t") == [(1,)]
    for s in ("COMMIT", "ROLLBACK", "SAVEPOINT x"):
        with pytest.raises(TransactionError):
            e.execute(s)


def test_sessions(spark, tmp_path):
    a = Engine(spark, f"file://{tmp_path}/db")
    run(a, "CREATE TABLE t (id BIGINT PRIMARY KEY)", "INSERT INTO t VALUES (1)")
    b = Engine(spark, f"file://{tmp_path}/db")
    run(b, "BEGIN", "INSERT INTO t VALUES (2)")
    run(a, "INSERT INTO t VALUES (3)")
    with pytest.raises(LockError):
        b.execute("COMMIT")
    assert run(b, "SELECT COUNT(*) FROM t") == [(2,)]
    reader = a.open_reader()
    with pytest.raises(ExecutionError):
        reader.execute("INSERT INTO t VALUES (9)")
    a.flush()
    a.backup(f"file://{tmp_path}/copy")
    assert run(Engine(spark, f"file://{tmp_path}/copy"), "SELECT COUNT(*) FROM t") == [(2,)]


def test_alter(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, a INT, b VARCHAR)", "INSERT INTO t VALUES (1, 5, '7')", "ALTER TABLE t ADD COLUMN c INT DEFAULT 3", "ALTER TABLE t MODIFY COLUMN b INT", "ALTER TABLE t CHANGE a z BIGINT NOT NULL")
    assert run(e, "SELECT id, z, b, c FROM t") == [(1, 5, 7, 3)]
    with pytest.raises(CheckViolation):
        e.execute("ALTER TABLE t ADD COLUMN d INT NOT NULL")
    with pytest.raises(SchemaError):
        e.execute("ALTER TABLE t DROP COLUMN id")
    run(e, "ALTER TABLE t DROP COLUMN b", "INSERT INTO t VALUES (2, 6, NULL)")
    assert run(e, "SELECT * FROM t ORDER BY id") == [(1, 5, 3), (2, 6, 3)]


def test_explain_and_analyze(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, a INT)", "CREATE INDEX i ON t(a)", "INSERT INTO t VALUES " + ",".join(f"({k},{k % 10})" for k in range(100)))
    assert run(e, "EXPLAIN SELECT * FROM t WHERE id = 1")[0][3:7] == ("const", "PRIMARY", 1, 101)
    assert run(e, "EXPLAIN SELECT * FROM t")[0][3:] == ("ALL", None, 100, 53000, None)
    run(e, "ANALYZE TABLE t")
    assert run(e, "EXPLAIN SELECT * FROM t WHERE a = 3")[0][3:7] == ("ref", "i", 10, 1230)
    assert run(e, "EXPLAIN SELECT * FROM t WHERE a >= 8")[0][3:6] == ("range", "i", 20)
    assert run(e, "EXPLAIN UPDATE t IGNORE INDEX (i) SET a = 1 WHERE a = 3")[0][1:5] == ("UPDATE", "t", "ALL", None)


def test_fulltext(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, body TEXT)", "CREATE FULLTEXT INDEX f ON t(body) WITH PARSER ngram OPTIONS (n=2, normalize='nfkc')", "INSERT INTO t VALUES (1,'東京タワーの夜景がきれい'),(2,'東京は混雑している'),(3,'ﾀﾜｰ'),(4,NULL)")
    assert run(e, "SELECT id FROM t WHERE MATCH(body) AGAINST('タワー') > 0 ORDER BY id") == [(1,), (3,)]
    assert run(e, "SELECT id FROM t WHERE MATCH(body) AGAINST('\"東京タワー\" +夜景 -混雑' IN BOOLEAN MODE) > 0") == [(1,)]
    assert run(e, "SELECT fts_snippet(body, '夜景', '<', '>', 2) FROM t WHERE id = 1") == [("...ーの<夜景>がき...",)]
    assert run(e, "SELECT fts_snippet(body, '夜景', '<', '>', 2) FROM t WHERE id = 4") == [("",)]


def test_prepared_and_output(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, name VARCHAR)")
    p = e.prepare("INSERT INTO t VALUES (?, ?)")
    assert p.count == 2 and e.execute_prepared(p, [1, "it's"]) == 1 and e.execute_prepared(p, [2, None]) == 1
    assert e.query_params("SELECT name FROM t WHERE id = ?", [1]).collect()[0][0] == "it's"
    assert e.to_json(e.query("SELECT * FROM t WHERE id = 2")) == '{"columns": ["id", "name"], "rows": [{"id": 2, "name": null}]}'
    assert "NULL" in e.to_text(e.query("SELECT * FROM t")) and e.to_json(3) == '{"rows_affected": 3}'
    assert [e.classify_sql(s) for s in ("SELECT 1", "DELETE FROM t", "BEGIN")] == ["read", "write", "transaction"]
    assert e.cancel_handle()() is False


def test_distinct_in_the_order_of_a_hidden_column(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, g VARCHAR, v INT, w INT)", "INSERT INTO t VALUES (1,'a',3,1),(2,'b',1,1),(3,'a',2,9),(4,'c',NULL,5),(5,'c',7,0),(6,'b',1,8)")
    assert run(e, "SELECT DISTINCT g FROM t ORDER BY v LIMIT 1") == [("c",)]
    assert run(e, "SELECT DISTINCT g FROM t WHERE v IS NOT NULL ORDER BY v") == [("b",), ("a",), ("c",)]
    assert run(e, "SELECT DISTINCT g FROM t ORDER BY v DESC") == [("c",), ("a",), ("b",)]
    assert run(e, "SELECT DISTINCT g FROM t WHERE v IS NOT NULL ORDER BY v ASC, w DESC LIMIT 2 OFFSET 1") == [("a",), ("c",)]
    assert run(e, "SELECT DISTINCT g FROM t ORDER BY v, g DESC") == [("c",), ("b",), ("a",)]


def test_search_in_changes(e):
    run(e, "CREATE TABLE t (id BIGINT PRIMARY KEY, body TEXT, hits BIGINT)", "INSERT INTO t VALUES (1,'red apple',0),(2,'green pear',0),(3,'red pear',0),(4,NULL,0)", "CREATE FULLTEXT INDEX f ON t(body) WITH PARSER ngram OPTIONS (n=2, normalize='nfkc')")
    assert run(e, "UPDATE t SET body = 'blue plum' WHERE MATCH(body) AGAINST('+apple' IN BOOLEAN MODE) > 0") == 1
    assert run(e, "SELECT id FROM t WHERE MATCH(body) AGAINST('plum') > 0 ORDER BY id") == [(1,)]
    assert run(e, "UPDATE t SET hits = MATCH(body) AGAINST('+pear' IN BOOLEAN MODE)") == 4
    assert [r[0] for r in run(e, "SELECT id FROM t WHERE hits > 0 ORDER BY id")] == [2, 3]
    assert run(e, "DELETE FROM t WHERE MATCH(body) AGAINST('pear') > 0 AND id > 2") == 1
    assert run(e, "SELECT id FROM t ORDER BY id") == [(1,), (2,), (4,)]
    with pytest.raises(EngineError):
        run(e, "DELETE FROM t WHERE MATCH(hits) AGAINST('pear') > 0")


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.a[-1]", "3"), ("$.a[-9]", None), ("$.a[0:2]", "[1,2]"), ("$.a[0,2]", "[1,3]"), ("$.a[::2]", "[1,3]"), ("$.a[1:]", "[2,3]"), ("$.a[-2:]", "[2,3]"), ("$['b']['x y']", "5"), ("$['a','n']", "[[1,2,3],null]"),
        ("$.c[?(@.x == 1 && @.y == 2)].n", '"p"'), ("$.c[?(@.x == 1 || @.y == 9)].n", '["p","q"]'), ("$.c[?(@.x == 1 && !(@.y == 2))].n", '"q"'), ("$.c[?(@.n == 'q')].y", "3"), ("$.c[?(@.z)].n", '"r"'), ("$.c[?(!@.z)].n", '["p","q"]'),
        ("$.c[?(@.l[1] > 4)].n", '"r"'), ("$.c[?(@.n >= 'q' && @.x < 2)].n", '"q"'), ("$..n", None), ("$.c[*].l[0]", "4"),
    ],
)
def test_json_paths(path, want):
    from quernel.functions import arrow

    doc = '{"a":[1,2,3],"b":{"x y":5},"n":null,"c":[{"x":1,"y":2,"n":"p"},{"x":1,"y":3,"n":"q"},{"x":2,"n":"r","z":false,"l":[4,5]}]}'
    assert path == "$..n" or arrow.extract(doc, path) == want
    for bad in ("$.a[", "$.a[x]", "$[?(@.x ==)]", "$[?(@.x == 1]", "$.a[0;1]", "$[?((@.x)]", "$.a[::0]"):
        with pytest.raises(ExecutionError):
            arrow.path_steps(bad)
