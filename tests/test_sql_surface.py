import json

import pytest

from fieldmark.functions.dialect import DialectError, to_spark
from fieldmark.functions.guard import ReadOnlySqlError, assert_read_only
from fieldmark.functions.shaping import MARK, bounded, size
from fieldmark.plans.statement import Catalog

GOOD = [
    "SELECT 1", "  select 1", "WITH x AS (SELECT 1) SELECT * FROM x", "EXPLAIN QUERY PLAN SELECT 1", "-- hi\nSELECT 1", "/* DROP */ SELECT 1", "SELECT 'DROP TABLE x; DELETE'", "SELECT updated_at, created_by FROM t", "SELECT 1;", "SELECT ';' -- ; x", 'SELECT "delete" FROM t', "SELECT a[1] FROM t", "SELECT 1 AS reflected",
]
BAD = [
    "INSERT INTO t VALUES (1)", "update t set a = 1", "DROP TABLE t", "PRAGMA x", "ATTACH 'a'", "WITH x AS (SELECT 1) DELETE FROM t", "/* SELECT */ DROP TABLE t", "BEGIN", "SELECT 1; ANALYZE", "SELECT 1; SELECT 2", "", "-- only", "SELECT replace(a, 'b', 'c')",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('a', 'b')", "SELECT try_reflect('a', 'b')", "SELECT `reflect`('a', 'b')", "SELECT TRANSFORM (a) USING 'sh' FROM t", "SELECT * FROM parquet.`/etc`", "SELECT * FROM a , parquet.`/etc`", "EXPLAIN SET x = 1", "WITH x AS (SELECT 1) MERGE INTO t USING x", "EXPLAIN", "SELECT 'x",
]


@pytest.mark.parametrize("sql", GOOD)
def test_admitted(sql):
    assert_read_only(sql)


@pytest.mark.parametrize("sql", BAD[:-1])
def test_refused(sql):
    with pytest.raises(ReadOnlySqlError):
        assert_read_only(sql)


def test_messages():
    with pytest.raises(ReadOnlySqlError, match="must begin with SELECT, WITH, or EXPLAIN"):
        assert_read_only("VACUUM")
    with pytest.raises(ReadOnlySqlError, match="DROP statements are not permitted"):
        assert_read_only("WITH x AS (SELECT 1) DROP TABLE t")
    with pytest.raises(ReadOnlySqlError, match="only one statement"):
        assert_read_only("SELECT 1; x")


def test_dialect():
    assert to_spark("SELECT ?1, ?2 WHERE a IS NOT 'WC' AND b IS ?1 AND c IS NOT NULL") == "SELECT :p1, :p2 WHERE a IS DISTINCT FROM 'WC' AND b IS NOT DISTINCT FROM :p1 AND c IS NOT NULL"
    assert to_spark("SELECT [my col], x[1], '[a] IS b LIKE'") == "SELECT `my col`, x[1], '[a] IS b LIKE'"
    assert "ILIKE 'a%'" in to_spark("SELECT a LIKE 'a%'")
    assert to_spark("SELECT \"a b\", x.y COLLATE NOCASE") == "SELECT `a b`, x.y COLLATE UTF8_LCASE"
    assert "INTERVAL '-3' DAY" in to_spark("SELECT date(d, '-3 days')")
    for sql in ("SELECT date('now')", "SELECT a GLOB b", "SELECT date(d, 'weekday 0')", "SELECT strftime('%q', d)"):
        with pytest.raises(DialectError):
            to_spark(sql)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("'Rich' GLOB 'R*h'", True), ("'eRic' GLOB 'Rich*'", False), ("'Rich' GLOB 'r*'", False), ("'a.c' GLOB 'a.?'", True), ("'abc' GLOB 'a.c'", False), ("'b1' GLOB '[a-c][0-9]'", True), ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("7 / 0", None), ("2 * 7 / 4", 3), ("100.0 * 3 / 8", 37.5), ("8 / 2 / 2", 2), ("(1 + 6) / (1 + 1)", 3),
        ("CAST('12abc' AS INTEGER)", 12), ("CAST('x' AS INTEGER)", 0), ("CAST(3.7 AS INTEGER)", 3), ("CAST('3.75kg' AS REAL)", 3.75), ("CAST(NULL AS INTEGER)", None), ("CAST(12 AS TEXT)", "12"), ("total(x)", 3.0), ("total(coalesce(x, 0))", 3.0), ("total(nullif(x, x))", 0.0), ("SUM(x > 1)", 1), ("SUM((x IS NULL))", 0), ("SUM(CASE WHEN x > 1 THEN 5 END)", 5),
        ("max(3, 9)", 9), ("max(3, NULL)", None), ("max(x)", 2), ("json_valid('[1]')", 1), ("json_valid('[1')", 0), ("json_valid(NULL)", None), ("json_array_length('[1, 2, 3]')", 3), ("json_extract('{\"a\": {\"b\": 4}}', '$.a.b')", "4"), ("datetime('2024-02-29 10:00:00', '+1 year', '-1 hour')", "2025-02-28 09:00:00"), ("date('now', 'start of month')", "2024-05-01"),
        ("strftime('%Y-%m-%dT%H:%M:%fZ', 'now')", "2024-05-06T07:08:09.000Z"), ("strftime('%w', '2024-05-05')", "0"), ("julianday('2000-01-01 12:00:00')", 2451545.0), ("ifnull(NULL, 'b')", "b"), ("iif(1 > 2, 'a', 'b')", "b"), ("'ABC' LIKE 'a%'", True), ("1 IS NOT NULL", True), ("'a' IS 'a'", True), ("typeof(random())", "bigint"), ("'a' COLLATE NOCASE = 'A'", True), ("group_concat(x)", "1,2"),
    ],
)
def test_sqlite_values(spark, sql, want):
    got = spark.sql(to_spark(f"SELECT {sql} AS v FROM VALUES (1), (2) AS t(x) LIMIT 1", now="2024-05-06 07:08:09")).first().v
    assert (got == want if want is not None else got is None), got


def test_bare_columns_and_json_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5, "[7, 8]"), (2, "b", 6, "[]"), (1, "a", 7, None)], "id long, name string, x int, tags string").write.parquet(f"{tmp_path}/t.parquet")
    c = Catalog(spark, str(tmp_path), ("t",), now="2024-05-06")
    rows = c.query("SELECT t.name, upper(name) AS u, sum(x) AS s FROM t GROUP BY t.id ORDER BY s DESC")["results"]
    assert [(r["name"], r["u"], r["s"]) for r in rows] == [("a", "A", 12), ("b", "B", 6)]
    assert c.query("SELECT id FROM t WHERE id IN (SELECT value FROM json_each(?1)) GROUP BY id", "[2, 9]")["results"] == [{"id": 2}]
    assert [r["value"] for r in c.query("SELECT t.id, j.value FROM t, json_each(t.tags) AS j WHERE t.x < 9 ORDER BY j.value")["results"]] == ["7", "8"]


def test_statement(spark, tmp_path):
    spark.createDataFrame([(1, "a", None), (2, "B", 2.5)], "id long, name string, x double").write.parquet(f"{tmp_path}/t.parquet")
    c = Catalog(spark, str(tmp_path), ("t",))
    s = c.prepare("SELECT id FROM t WHERE name LIKE ?1 OR id = ?2 ORDER BY id")
    assert s.bind("b", 1).all()["results"] == [{"id": 1}, {"id": 2}]
    assert s.bind("b", 1).bind("zz", 2).first() == {"id": 2}
    assert c.query_first("SELECT id FROM t WHERE id > ?", 9) is None
    assert c.query("SELECT x FROM t WHERE x IS NULL")["meta"] == {"rows_read": 1, "stopped_short": False}
    with pytest.raises(ReadOnlySqlError):
        c.query("DROP TABLE t")
    assert len(c.batch([c.prepare("SELECT count(*) AS n FROM t")] * 2)) == 2
    assert json.loads(c.prepare("SELECT id FROM t WHERE id = 1").text()) == [{"id": 1}]


def test_bounded_results():
    small = [{"a": 1}]
    assert bounded(list(small), 1000) == small
    rows = bounded([{"k": i, "text": "x" * 50} for i in range(5000)], 10_000)
    assert size(rows) <= 10_000 and rows[0]["k"] == 0 and rows[-1].startswith(MARK) and "of 5000 items" in rows[-1]
    text = bounded({"a": "y" * 50_000}, 2_000)
    assert size(text) <= 2_000 and text["a"].startswith("y" * 100)
    assert isinstance(bounded({str(i): 1 for i in range(2000)}, 500), str)
    # what is asked of any shape: within the limit, first things kept, the argument left as it was
    shapes = [
        {"rows": [{"id": i, "note": "\n" * 30} for i in range(3000)], "title": "t" * 300, "n": 3},
        [["é" * 900, 1], ["b" * 90_000, {"c": [1] * 9000}]],
        {"a": "x" * 3000, "b": "y" * 3000, "c": "z" * 20},
        [{"only": "w" * 30_000}],
        ["s" * 120] * 40,
    ]
    for value in shapes:
        before = json.dumps(value)
        for limit in (1500, 3000, 20_000):
            got = bounded(value, limit)
            assert size(got) <= limit and json.dumps(value) == before
            assert not isinstance(got, str) or limit == 1500
    both = bounded(shapes[2], 3000)
    assert both["c"] == "z" * 20 and abs(len(both["a"]) - len(both["b"])) < 30 and MARK in both["a"]
    kept = bounded(shapes[4], 3000)
    assert kept[0] == "s" * 120 and f"first {len(kept) - 1} of 40 items" in kept[-1]
