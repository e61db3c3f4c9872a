"""Tables that SQL text reads and writes.

Patterns find the names behind the few clauses that introduce a table; nothing else of a
statement is looked at, and text without such a clause has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

READS = "READS_TABLE"
WRITES = "WRITES_TABLE"


def with_name_lists(df: DataFrame, sql: Column) -> DataFrame:
    """Add ``_reads``, ``_writes`` and ``_ctes``: the raw names found in ``sql``."""
    return df.withColumn("_clean", tx.strip_noise(sql)).select(
        *df.columns,
        tx.names_after(F.col("_clean"), *tx.READ_CLAUSES).alias("_reads"),
        tx.names_after(F.col("_clean"), *tx.WRITE_CLAUSES).alias("_writes"),
        tx.names_after(F.lower("_clean"), tx.CTE_CLAUSE).alias("_ctes"),
    )


def explode_names(df: DataFrame, as_is: Column | None = None) -> DataFrame:
    """Name lists to rows: a table both read and written counts as written, and neither a
    name defined by the statement itself nor a keyword is a table. Rows marked ``as_is``
    hold names that were given directly and are not checked."""
    keep = [c for c in df.columns if c not in ("_reads", "_writes", "_ctes")]
    df = df.withColumn("_as_is", F.lit(False) if as_is is None else as_is)
    tagged = F.array(
        F.struct(
            F.lit(READS).alias("type"),
            F.array_except("_reads", "_writes").alias("names"),
        ),
        F.struct(F.lit(WRITES).alias("type"), F.array_distinct("_writes").alias("names")),
    )
    name = F.lower("table_name")
    # A bare array_contains() would let the optimizer test _ctes for null further down, and
    # for that compute it a second time.
    own_name = F.coalesce(F.array_contains("_ctes", name), F.lit(False))
    return (
        df.select(*keep, "_as_is", "_ctes", F.inline(tagged))
        .select(*keep, "_as_is", "_ctes", "type", F.explode("names").alias("table_name"))
        .where(
            (name != "")
            & (
                F.col("_as_is")
                | (~name.isin(*tx.NOT_A_TABLE) & ~own_name)
            )
        )
        .select(*keep, "table_name", "type")
    )


def sql_table_refs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per (kept columns, table_name, type) and input row; ``text`` itself is
    dropped unless it is kept."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    columns = list(dict.fromkeys([*keep, text]))
    return explode_names(with_name_lists(df.select(*columns), F.col(text))).select(
        *keep, "table_name", "type"
    )


def known_table_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References to tables with at least one live column."""
    live = catalog.select("table_name")
    return refs.join(live, "table_name", "left_semi").select(*refs.columns)
