"""What SQL text reads and writes: all cases run as rows of one DataFrame."""

import pytest
from pyspark.sql import functions as F

from lakeimpact.operators.sqlrefs import known_table_refs, sql_table_refs

# name: (text, reads, writes)
CASES = {
    "one read": ("TABLESAMPLE aside, FROM port.quays q LIMIT 3", {"port.quays"}, set()),
    "create or replace": (
        "create  or\treplace table berths using delta partitioned by (dock) as (values (1, 'x'));\nrefresh table berths",
        set(),
        {"berths"},
    ),
    "create if not exists": ("CREATE TABLE IF NOT EXISTS t1 AS SELECT * FROM t2", {"t2"}, {"t1"}),
    "create view": ("create view v as select 1 from s.t", {"s.t"}, {"v"}),
    "insert overwrite": (
        "FROM port.calls c JOIN tides USING (hour) insert overwrite table port.log partition (year = 7) select c.ship",
        {"port.calls", "tides"},
        {"port.log"},
    ),
    "insert into table": ("INSERT INTO TABLE g.c VALUES (1)", set(), {"g.c"}),
    "joins": ("SELECT 1 FROM s.a x\nLEFT JOIN s.b y USING (k) JOIN c ON 1=1", {"s.a", "s.b", "c"}, set()),
    "cte": ("with busy as (select dock, n from port.calls where n > 9) select max(n) from busy", {"port.calls"}, set()),
    "comments and literals": (
        "SELECT n, 'see JOIN port.none' /* UPDATE port.never */\nFROM port.calls\n-- INSERT INTO port.off\n",
        {"port.calls"},
        set(),
    ),
    "backticks and plain": ("SELECT 1 FROM ships CROSS JOIN `port`.`old calls`", {"ships", "port.old"}, set()),
    "unknown shape": ("GRANT SELECT ON port.calls TO crew", set(), set()),
    # Fixed against naive matching.
    "chained ctes": ("WITH a AS (SELECT 1 FROM t), b AS (SELECT * FROM a) SELECT * FROM b", {"t"}, set()),
    "recursive cte": ("WITH RECURSIVE n AS (SELECT 1 UNION ALL SELECT * FROM n) SELECT * FROM n", set(), set()),
    "column list": ("WITH r(x, y) AS (SELECT 1, 2) SELECT * FROM r JOIN t", {"t"}, set()),
    "cte case": ("WITH Recent AS (SELECT * FROM t) SELECT * FROM RECENT", {"t"}, set()),
    "dashes in literal": ("SELECT '--' AS z FROM t", {"t"}, set()),
    "quote in comment": ("-- don't\nSELECT * FROM t -- isn't\nJOIN u", {"t", "u"}, set()),
    "doubled quote": ("SELECT 'it''s FROM x' FROM t WHERE a = '''' AND b IN (SELECT 1 FROM u)", {"t", "u"}, set()),
    "merge update set": (
        "MERGE INTO w USING s ON a = b WHEN MATCHED THEN UPDATE SET x = 1",
        set(),
        {"w"},
    ),
    "update": ("UPDATE s.t SET x = 1", set(), {"s.t"}),
    # Kept limits.
    "read and written": ("INSERT OVERWRITE t SELECT * FROM t JOIN u", {"u"}, {"t"}),
    "four parts": ("SELECT * FROM a.b.c.d", {"a.b.c"}, set()),
    "comma join": ("SELECT * FROM a, b", {"a"}, set()),
    "delete": ("DELETE FROM t WHERE 1 = 1", {"t"}, set()),
    "extract": ("SELECT EXTRACT(day FROM ts) FROM t", {"ts", "t"}, set()),
    "keywords": ("SELECT * FROM (SELECT 1) JOIN LATERAL x JOIN unnest(a) , VALUES", set(), set()),
    "hyphen": ("SELECT * FROM `my-table`", {"my"}, set()),
    "quoted column": ("SELECT `from` AS f, `join` x FROM t", {"t"}, set()),
    "word edges": ("SELECT xFROM a, fromage b, _JOIN c, JOINT d FROM t", {"t"}, set()),
    "letters of other scripts": ("SELECT éFROM a FROM naïve.table_é", {"naïve.table_é"}, set()),
    "wide blanks": ("SELECT 1 FROM\u00a0\n\t t\u2003JOIN\u3000u", {"t", "u"}, set()),
    "empty": ("", set(), set()),
    "unfinished": ("SELECT 1 FROM t WHERE a = 'open FROM x /* FROM y", {"t", "x", "y"}, set()),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)], "id string, text string")
    refs = {}
    for r in sql_table_refs(df).collect():
        refs.setdefault(r["id"], []).append((r["type"], r["table_name"]))
    return refs


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    _, reads, writes = CASES[case]
    expected = {("READS_TABLE", t) for t in reads} | {("WRITES_TABLE", t) for t in writes}
    got = found.get(case, [])
    assert set(got) == expected
    assert len(got) == len(expected), "a table is named once per direction"


def test_null_text_has_no_references(found):
    assert "null" not in found


def test_long_text_is_read_whole(spark, rows):
    filler = "SELECT '" + "x''y" * 50_000 + "' /* " + "* " * 50_000 + "*/ -- " + "z" * 100_000 + "\n"
    df = spark.createDataFrame([(filler + "FROM far.away",)], "text string")
    assert rows(sql_table_refs(df)) == [("far.away", "READS_TABLE")]


def test_known_tables_only(spark, rows):
    refs = spark.createDataFrame(
        [("q", "s.a", "READS_TABLE"), ("q", "ts", "READS_TABLE")], "id string, table_name string, type string"
    )
    catalog = spark.range(3).select(F.lit("s.a").alias("table_name"), F.col("id").alias("column_name"))
    assert rows(known_table_refs(refs, catalog)) == [("q", "s.a", "READS_TABLE")]


def test_names_are_computed_once(spark):
    """The optimizer must not repeat the patterns in a filter it adds by itself."""
    df = spark.createDataFrame([("a", "b")], "id string, text string")
    plan = sql_table_refs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert plan.count("regexp_extract_all(") == 7
