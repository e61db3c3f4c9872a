"""Source texts with ``<column>`` marks, filled per row by Spark and by the check SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

MARK = re.compile(r"<(\w+)>")

# SQL statements, chosen by o_orderkey % 8. r, r2: tables read; w: table written.
STATEMENTS = [
    "SELECT a FROM <r> WHERE a > 1",
    "CREATE OR REPLACE TABLE <w> AS\nSELECT a\nFROM <r> x\nJOIN <r2> y USING (a)",
    "INSERT OVERWRITE <w>\nSELECT a FROM <r>",
    "WITH c1 AS (SELECT * FROM <r>), C2 AS (SELECT * FROM c1)\nSELECT * FROM c2",
    "SELECT concat('UPDATE main.fake.t', ' -- ') AS hint\nFROM <r> /* INSERT INTO main.blk.t */\n"
    "-- it's JOIN main.dead.t\nJOIN <r2>",
    "SELECT count(*) FROM lookup RIGHT JOIN `main`.`l`.`t` ON true",
    "MERGE INTO <w> USING s ON a=b WHEN MATCHED THEN UPDATE SET x = 1",
    "DESCRIBE EXTENDED main.l1",
]

# CTE shapes, chosen by o_orderkey % 5.
CTES = [
    "WITH a AS (SELECT * FROM <r>), b AS (SELECT * FROM a) INSERT INTO <w> SELECT * FROM b",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n FROM T) SELECT * FROM t JOIN <r>",
    "WITH One AS (SELECT 1), `Two` (x, y) AS (SELECT x FROM one) SELECT * FROM two, three",
    "with a as (select * from <r>)\n, b as (select * from <r2>) select * from A join B",
    "CREATE VIEW <w> AS WITH q AS (SELECT * FROM <w>) SELECT * FROM q JOIN <r> ON 1 = 1",
]

# Python files, chosen by o_orderkey % 6. l: layer number, c: table number.
PYTHON = [
    'ZONE = "main"\nPLACE = f"{ZONE}.l<l>.t<c>"\ndef rows_of(session):\n'
    '    return session.read.table(PLACE)\n',
    'def save(df):\n    df.write.mode("overwrite").saveAsTable("main.l<l>.t<c>")\n',
    'SOURCE = "main.l<l>.t<c>"\ndef build(spark):\n    spark.sql(\n        f"""\n'
    "        CREATE OR REPLACE TABLE main.l9.t<c> AS\n"
    '        SELECT * FROM {SOURCE} WHERE note <> \'FROM x\'"""\n    )\n',
    "def guess(spark, prefix):\n    spark.table(f\"{prefix}.t<c>\")\n"
    '    spark.read.table("s3://quays/t<c>.parquet")\n    spark.sql(prefix)\n'
    'plain = spark.read.table("main.l<l>.t<c>")\n',
    'class Log\n    rows = spark.table("main.l<l>.t<c>")\n',
    'def both(spark, df):\n    spark.table("main.l<l>.t<c>"), spark.table("main.l<l>.t<c>")\n'
    '    df.write.insertInto(TARGET)\nTARGET = f"{BASE}.t<c>"\nBASE = "main.l<l>"\n',
]


def fill(template: str) -> Column:
    """The template as a Spark expression over the marked columns."""
    parts = MARK.split(template)
    return F.concat(
        *[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    )


def choose(number: Column, templates: list[str]) -> Column:
    """The template whose position is ``number``."""
    chosen = F.when(number == 0, fill(templates[0]))
    for i, template in enumerate(templates[1:], 1):
        chosen = chosen.when(number == i, fill(template))
    return chosen


def fill_sql(template: str) -> str:
    """The template as a DuckDB expression."""
    parts = MARK.split(template)
    quoted = [p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts)]
    return "concat(" + ", ".join(quoted) + ")"


def choose_sql(number: str, templates: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {fill_sql(t)}" for i, t in enumerate(templates))
    return f"CASE {number} {whens} END"
