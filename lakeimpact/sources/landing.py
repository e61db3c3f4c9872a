"""Files as they arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("revenue_cents", T.LongType()),
        T.StructField("country", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON events. With a schema (such as ``EVENTS``) the files are read once; without one
    Spark reads them a first time to infer it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """CSV users with a header line; every column is text."""
    return spark.read.option("header", True).csv(path)


def stamp(df: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    """Add ``_ingested_at``: the given moment, or the start of the query."""
    at = (
        F.current_timestamp()
        if ingested_at is None
        else F.lit(ingested_at.isoformat(sep=" ")).cast("timestamp")
    )
    return df.withColumn("_ingested_at", at)
