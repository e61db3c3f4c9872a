"""Readers and sinks over temporary folders and tables."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from lakeimpact.operators.checkpoints import checkpoints_normalized, latest_checkpoint
from lakeimpact.plans import pipeline
from lakeimpact.sources import files, landing, records, tables


def test_source_files(spark, tmp_path, rows):
    def put(path, content):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)

    put("a.sql", b"SELECT 1\r\nFROM t\rx")
    put("pkg/__init__.py", "é = 1".encode())
    put("pkg/.hidden.py", b"x")
    put("pkg/deep/er/_q.sql", b"")
    put("pkg/latin.py", "é".encode("latin-1"))
    put("pkg/notes.txt", b"no")
    put("pkg/.sql", b"no suffix")
    put("pkg/UPPER.SQL", b"no")
    put(".git/hook.py", b"no")
    put("pkg/.venv/lib/x.py", b"no")
    put("pkg/.venv2/y.py", b"yes")
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path)
    (tmp_path / "linked.py").symlink_to(tmp_path / "pkg" / "__init__.py")
    assert rows(files.read_source_files(spark, str(tmp_path))) == [
        ("a.sql", "SELECT 1\nFROM t\nx"),
        ("linked.py", "é = 1"),
        ("pkg/.hidden.py", "x"),
        ("pkg/.venv2/y.py", "yes"),
        ("pkg/__init__.py", "é = 1"),
        ("pkg/deep/er/_q.sql", ""),
    ]


def test_symbol_lines(spark, tmp_path):
    (tmp_path / "s.ndjson").write_text(
        '{"record_type":"symbol","id":"b","name":"f","kind":"function","file_path":"x.py","start_line":2,"end_line":5}\n'
        '{broken\n3\n[]\n{"record_type":"relation","id":"r"}\n'
        '{"record_type":"symbol","id":"a"}\n'
    )
    lines = records.read_symbol_lines(spark, str(tmp_path))
    got = records.symbols_from_ndjson(lines).orderBy("ordinal").drop("ordinal").collect()
    assert [tuple(r) for r in got] == [("b", "f", "function", "x.py", 2, 5), ("a", "", "", "", 0, 0)]


def test_symbol_without_id_fails(spark):
    df = spark.createDataFrame([('{"record_type":"symbol","name":"f"}',)], "value string")
    with pytest.raises(Exception, match="without an id"):
        records.symbols_from_ndjson(df).collect()


def test_oversized_records_fail(spark):
    """Valid JSON with a string beyond what the reader takes does not pass for malformed text."""
    note = F.concat(F.lit('"note":"'), F.repeat(F.lit("x"), F.col("n")), F.lit('"'))
    sizes = spark.createDataFrame([(21_000_000,)], "n int")
    line = sizes.select(F.concat(F.lit('{"record_type":"symbol","id":"a",'), note, F.lit("}")).alias("value"))
    with pytest.raises(Exception, match="symbol line of 210000.. bytes"):
        records.symbols_from_ndjson(line).collect()
    listed = F.concat(F.lit('[{"id":"k",'), note, F.lit("}]"))
    with pytest.raises(Exception, match="checkpoint list of 210000.. bytes"):
        found = checkpoints_normalized(records.checkpoint_envelopes(sizes.select(F.lit("b").alias("branch"), listed.alias("payload"))))
        latest_checkpoint(found).collect()
    broken = sizes.select(F.lit("{oops").alias("value"))
    assert records.symbols_from_ndjson(broken).collect() == []


def symbol(more):
    return '{"record_type":"symbol","id":"a",' + more + "}"


REFUSED = {
    "long number": symbol('"n":' + "7" * 1200),
    "long name": symbol(f'"{"k" * 60_000}":1'),
    "deep": symbol('"x":' + "[" * 1200 + "]" * 1200),
    "name twice": symbol('"id":"b"'),
}


@pytest.mark.parametrize("name", REFUSED)
def test_lines_beyond_the_reader_fail(spark, name):
    from lakeimpact.functions import semi

    df = spark.createDataFrame([(REFUSED[name],)], "value string")
    if df.select(semi.parse(F.col("value")).isNull()).first()[0]:
        with pytest.raises(Exception, match="symbol line of"):
            records.symbols_from_ndjson(df).collect()
        listed = df.selectExpr("'b' AS branch", "concat('[', value, ']') AS payload")
        with pytest.raises(Exception, match="checkpoint list of"):
            records.checkpoint_envelopes(listed).collect()
    else:
        assert [r["id"] for r in records.symbols_from_ndjson(df).collect()] == ["a"]


JSON_TEXTS = ['{}', '[]', '3', '"x"', ' [1, -2.5e+7 ,true,null,"a\\"b\\u00e9\\\\"] ', '{"a":{"b":[[],{}]},"":0}', '[{"a":1},{"b":[2]}]', "0", '"é日"', '{"a":"}]"}']
OTHER_TEXTS = ["", " ", "{", "[1,]", "[1 2]", '{"a"}', '{"a":1,}', "{a:1}", "01", "1.", ".5", "+1", "tru", '"open', '"\\x"', '"\t"', "[}", '{"a":1]', "[1]]", "[[1]",
               "'a'", "\x01", "[\x02]", "NaN", "1 2", '{"a":1 "b":2}', '{1:2}', "[,1]", "\\u0041", "{oops", "nulll", '"a""b"']


def test_is_json_agrees_with_the_library(spark):
    import json

    from lakeimpact.functions import semi

    draw = random.Random(4)
    texts = JSON_TEXTS + OTHER_TEXTS
    for _ in range(400):  # changed by a character
        text = draw.choice(JSON_TEXTS)
        at = draw.randrange(len(text))
        texts.append(text[:at] + draw.choice(["", *'{}[]",:\\0 etn']) + text[at + draw.randrange(2) :])

    def known(text):
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["j"] for r in df.select("t", semi.is_json(F.col("t")).alias("j")).collect()}
    assert [t for t in texts if got[t] != known(t)] == []
    assert all(got[t] for t in JSON_TEXTS) and not any(got[t] for t in OTHER_TEXTS)
    long = spark.range(1).select(F.concat(F.lit("["), F.repeat(F.lit('"x\\n",'), F.lit(300_000)), F.lit("0]")).alias("t"))
    assert long.select(semi.is_json(F.col("t"))).first()[0]


def test_columns_of_files(spark, tmp_path, rows):
    spark.range(3).selectExpr("id", "array(1) AS xs", "cast(1 AS decimal(9,2)) AS d").write.parquet(str(tmp_path / "one"))
    spark.range(3).selectExpr("cast(id AS string) AS name", "current_timestamp() AS at").write.partitionBy("name").parquet(str(tmp_path / "two"))
    listed = spark.createDataFrame(
        [("cat.one", str(tmp_path / "one")), ("cat.two", str(tmp_path / "two")), ("cat.none", str(tmp_path / "none"))], "table_name string, path string"
    )
    got = rows(tables.file_columns(listed))
    assert got == [
        ("cat.one", "d", "decimal(9,2)", 2), ("cat.one", "id", "bigint", 0), ("cat.one", "xs", "array<int>", 1), ("cat.two", "at", "timestamp", 0),
    ]
    assert rows(tables.file_columns(listed.limit(0))) == []


def test_a_failing_replacement_leaves_the_old_rows(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS sink")
    spark.sql("DROP TABLE IF EXISTS sink.kept")
    tables.replace_table_as(spark.createDataFrame([(1, "a")], "x int, y string"), "sink.kept")
    failing = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("half way")).cast("int")).otherwise(1).alias("z"))
    with pytest.raises(Exception, match="half way"):
        tables.replace_table_as(failing, "sink.kept")
    assert rows(spark.table("sink.kept")) == [(1, "a")]
    assert [t.name for t in spark.catalog.listTables("sink") if t.name.startswith("kept")] == ["kept"]
    # The select may read the table that it replaces.
    tables.replace_table_as(spark.table("sink.kept").selectExpr("x + 1 AS x", "y", "'n' AS z"), "sink.kept")
    assert rows(spark.table("sink.kept")) == [(2, "a", "n")]


def test_columns_of_tables(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS cat")
    spark.sql("DROP TABLE IF EXISTS cat.t")
    spark.range(1).selectExpr("id", "array(1) AS xs").write.saveAsTable("cat.t")
    got = rows(tables.live_columns(spark, ["cat.t", "cat.none", "not a name"]))
    assert got == [("cat.t", "id", "bigint", 0), ("cat.t", "xs", "array<int>", 1)]
    assert tables.table_exists(spark, "cat.t") and not tables.table_exists(spark, "cat.none")


def test_sinks(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS sink")
    spark.sql("DROP TABLE IF EXISTS sink.t")
    one, two = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2,)], "z int")
    tables.overwrite_table(one, "sink.t")
    tables.overwrite_table(two, "sink.t")
    assert spark.table("sink.t").columns == ["z"], "an overwrite replaces the schema"
    tables.replace_table_as(one, "sink.t")
    assert rows(spark.table("sink.t")) == [(1, "a")]
    by_position = spark.createDataFrame([(5, "p")], "y int, x string")
    tables.insert_overwrite(by_position, "sink.t")
    assert spark.table("sink.t").columns == ["x", "y"] and rows(spark.table("sink.t")) == [(5, "p")]
    spark.sql("DROP TABLE IF EXISTS sink.fresh")
    tables.insert_overwrite(one, "sink.fresh")
    assert rows(spark.table("sink.fresh")) == [(1, "a")]


EVENTS = """
{"user_id":1,"session_id":"s1","event_ts":"2024-01-30T10:00:00","revenue_cents":250,"country":"DE"}
{"user_id":1,"session_id":"s1","event_ts":"2024-01-30T09:00:00","revenue_cents":150,"country":"FR"}
{"user_id":2,"session_id":"s2","event_ts":"2024-01-30T11:00:00","revenue_cents":100}
{"user_id":9,"session_id":"s9","event_ts":"2024-01-31T09:00:00","revenue_cents":7,"country":"DE"}
{"user_id":1,"session_id":"s1","event_ts":null,"revenue_cents":999,"country":"US"}
{"user_id":2,"session_id":"s0","event_ts":"2024-01-28T00:00:00","revenue_cents":999,"country":"US"}
"""


def test_pipeline_from_landing_to_dashboard(spark, tmp_path, rows):
    (tmp_path / "events").mkdir()
    (tmp_path / "users").mkdir()
    (tmp_path / "events" / "e.json").write_text(EVENTS.strip())
    (tmp_path / "users" / "u.csv").write_text(
        "id,email,signup_date,plan_tier\n1,Ann@X.org,2024-01-01,pro\n2,Bo@x.org,2024-01-02,free\n,No@x.org,,free\n"
    )
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    at = datetime(2024, 1, 31)
    for _ in range(2):  # a second run replaces the first
        dashboard = pipeline.run(spark, str(tmp_path / "events"), str(tmp_path / "users"), at)
    day = datetime(2024, 1, 30).date()
    assert [tuple(r) for r in dashboard.collect()][0] == (datetime(2024, 1, 31).date(), None, Decimal("0.07"))
    assert rows(spark.table("gold.daily_revenue").where("day = '2024-01-30'")) == [
        (day, "free", 1.0, 1), (day, "pro", 4.0, 1),
    ]
    assert rows(spark.table("gold.user_retention")) == [("pro", "2024-01-01", 1)]
    assert rows(spark.table("gold.revenue_by_country")) == [("DE", Decimal("0.07")), ("FR", 4.0), (None, 1.0)]
    assert rows(spark.table("silver.users"), "user_id", "email") == [(1, "ann@x.org"), (2, "bo@x.org")]
    assert {f.name: f.dataType for f in spark.table("bronze.raw_users").schema}["id"] == T.StringType()
    assert spark.table("bronze.raw_events").where("_ingested_at = '2024-01-31'").count() == 6


def test_events_with_a_schema(spark, tmp_path):
    (tmp_path / "e.json").write_text(EVENTS.strip())
    df = landing.read_events(spark, str(tmp_path), landing.EVENTS)
    assert df.schema == landing.EVENTS and df.count() == 6
    assert "_ingested_at" in landing.stamp(df).columns


def test_unreadable_files_have_a_reason_and_failures_fail(tmp_path, spark, rows):
    (tmp_path / "a.sql").write_text("SELECT 1 FROM t")
    (tmp_path / "b.sql").write_bytes(b"\xff\xfe")
    got = rows(files.read_source_files(spark, str(tmp_path), with_reason=True))
    assert got == [("a.sql", "SELECT 1 FROM t", None), ("b.sql", None, "not UTF-8")]
    assert rows(files.read_source_files(spark, str(tmp_path))) == [("a.sql", "SELECT 1 FROM t")]


def test_a_read_is_tried_again_then_fails():
    class Flaky:
        def __init__(self, fails):
            self.fails = fails

        def open_input_stream(self, path):
            self.fails -= 1
            if self.fails >= 0:
                raise OSError("timeout")
            return open(__file__, "rb")

    assert files._text_of(Flaky(2), "x")[1] is None
    with pytest.raises(OSError):
        files._text_of(Flaky(3), "x")


def test_scratch_tables_can_be_released(spark):
    from lakeimpact.session import Scratch

    work = Scratch(spark, "released")
    assert work.cut(spark.range(3), "rows").count() == 3
    work.release()
    with pytest.raises(Exception):
        spark.read.parquet(f"{work.root}/rows").count()


def test_columns_of_an_information_schema(spark, rows):
    listed = spark.createDataFrame(
        [("main", "shelf", "stock", "Item", "BIGINT", 0, "x"), ("main", "shelf", "stock", "at", "DATE", 1, None)],
        "table_catalog string, table_schema string, table_name string, column_name string, data_type string, ordinal_position long, note string",
    )
    got = rows(tables.schema_table_columns(listed))
    assert got == [("main.shelf.stock", "Item", "bigint", 0), ("main.shelf.stock", "at", "date", 1)]
