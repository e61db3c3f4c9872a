"""Catalog tables: writing them, and the columns they have right now."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .files import open_root

CATALOG_COLUMNS = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
    ]
)


def overwrite_table(df: DataFrame, name: str) -> None:
    """Replace the rows and the schema of a table."""
    df.write.mode("overwrite").saveAsTable(name)


def replace_table_as(df: DataFrame, name: str) -> None:
    """CREATE OR REPLACE TABLE ... AS SELECT. The old rows stay until the new ones are all written.

    Where the catalog can't do it at once, the rows go to a table beside it, which then takes the name; only
    the change of names is between the two, and what fails before it leaves the old table.
    """
    spark = df.sparkSession
    parts = name.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    if catalog != "spark_catalog":
        df.writeTo(name).createOrReplace()
        return
    mark = uuid.uuid4().hex
    new, old = f"{name}_new_{mark}", f"{name}_old_{mark}"
    try:
        df.write.saveAsTable(new)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def insert_overwrite(df: DataFrame, name: str) -> None:
    """Replace the rows by position and keep the table's schema; the first write creates it."""
    if df.sparkSession.catalog.tableExists(name):
        df.write.insertInto(name, overwrite=True)
    else:
        df.write.saveAsTable(name)


def catalog_columns(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """(table_name, column_name, data_type, ordinal) of known schemas: metadata only."""
    rows = [
        (table, field.name, field.dataType.simpleString(), position)
        for table, schema in schemas.items()
        for position, field in enumerate(schema)
    ]
    return spark.createDataFrame(rows, CATALOG_COLUMNS)


def live_columns(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Columns of a few catalog tables by name, asked for one by one. A table that cannot be read has
    no rows, which the checks report as unverified. For many: ``schema_table_columns``."""
    schemas = {}
    for table in tables:
        try:
            schemas[table] = spark.table(table).schema
        except AnalysisException:
            continue
    return catalog_columns(spark, schemas)


def file_columns(listed: DataFrame) -> DataFrame:
    """Catalog columns (table_name, column_name, data_type, ordinal) of Parquet tables, from the footer of a file each.

    ``listed`` has table_name and path, a file or a folder. Footers are read where Spark spreads the paths to, no
    table is opened on the driver. A path without a Parquet file gives no rows, which the checks report as
    unverified; a column that only the folders name is none of the file's.
    """
    spark = listed.sparkSession
    named = listed.select("table_name", F.rtrim(F.col("path"), F.lit("/")).alias("path"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    return named.repartition(tasks, "path").mapInPandas(_footers, CATALOG_COLUMNS)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for table, path in zip(batch["table_name"], batch["path"]):
            rows += [(table, name, kind, i) for i, (name, kind) in enumerate(_footer(path))]
        yield pd.DataFrame(rows, columns=CATALOG_COLUMNS.names)


def _footer(path: str, tries: int = 3) -> list[tuple[str, str]]:
    """Names and types in the footer of the first Parquet file at or below the path; none where there is no such file."""
    for left in reversed(range(tries)):
        try:
            system, base = open_root(path)
            (info,) = system.get_file_info([base])
            if info.type == pafs.FileType.Directory:
                below = system.get_file_info(pafs.FileSelector(base, recursive=True))
                files = [f.path for f in below if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
            else:
                files = [base] if info.type == pafs.FileType.File else []
            if not files:
                return []
            with system.open_input_file(min(files)) as file:
                found = pq.ParquetFile(file)
                leaves = [found.schema.column(i) for i in range(len(found.schema))]
                # The old form of timestamps is an instant and does not say so.
                instants = {leaf.path.split(".")[0] for leaf in leaves if leaf.physical_type == "INT96"}
                return [(f.name, spark_type(f.type, f.name in instants)) for f in found.schema_arrow]
        except pa.ArrowInvalid:
            return []  # another format
        except OSError:
            if not left:
                raise


# How Spark writes the types of Parquet files.
_NAMES = {
    pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double",
    pa.bool_(): "boolean", pa.string(): "string", pa.large_string(): "string", pa.binary(): "binary", pa.date32(): "date",
}


def spark_type(kind: pa.DataType, instant: bool = False) -> str:
    """The simple name that Spark gives a column of this type."""
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    if pa.types.is_timestamp(kind):
        return "timestamp" if kind.tz or instant else "timestamp_ntz"
    if pa.types.is_map(kind):
        return f"map<{spark_type(kind.key_type, instant)},{spark_type(kind.item_type, instant)}>"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"array<{spark_type(kind.value_type, instant)}>"
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{spark_type(f.type, instant)}' for f in kind)}>"
    return _NAMES.get(kind, str(kind))


def table_exists(spark: SparkSession, table: str) -> bool:
    """Whether the table has at least one live column."""
    try:
        return len(spark.table(table).schema) > 0
    except AnalysisException:
        return False


def schema_table_columns(columns: DataFrame) -> DataFrame:
    """Catalog columns from rows in the shape of ``information_schema.columns``.

    The way for a catalog of any size: one scan, no table is opened, no name passes through the driver.
    """
    return columns.select(
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table_name"),
        "column_name",
        F.lower("data_type").alias("data_type"),
        F.col("ordinal_position").cast("int").alias("ordinal"),
    )
