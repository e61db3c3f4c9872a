"""The event pipeline from landing files to gold tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import medallion
from ..sources import landing
from ..sources.tables import insert_overwrite, overwrite_table, replace_table_as


@dataclass(frozen=True)
class Layers:
    """Where the tables live, such as ``Layers("main.bronze", "main.silver", "main.gold")``."""

    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"


def ingest_raw_events(spark: SparkSession, path: str, to: Layers, ingested_at: datetime | None = None, schema=None):
    raw = landing.read_events(spark, path, schema)
    overwrite_table(landing.stamp(raw, ingested_at), f"{to.bronze}.raw_events")


def ingest_users(spark: SparkSession, path: str, to: Layers):
    overwrite_table(landing.read_users(spark, path), f"{to.bronze}.raw_users")


def refresh_sessions(spark: SparkSession, to: Layers, as_of: datetime, window_minutes: int):
    raw = spark.table(f"{to.bronze}.raw_events")
    overwrite_table(medallion.clean_sessions(raw, as_of, window_minutes), f"{to.silver}.sessions")


def refresh_users(spark: SparkSession, to: Layers):
    users = medallion.clean_users(spark.table(f"{to.bronze}.raw_users"))
    replace_table_as(users, f"{to.silver}.users")


def refresh_gold(spark: SparkSession, to: Layers):
    sessions, users = spark.table(f"{to.silver}.sessions"), spark.table(f"{to.silver}.users")
    overwrite_table(medallion.daily_revenue(sessions, users), f"{to.gold}.daily_revenue")
    replace_table_as(medallion.user_retention(sessions, users), f"{to.gold}.user_retention")
    insert_overwrite(medallion.revenue_by_country(sessions), f"{to.gold}.revenue_by_country")


def dashboard(spark: SparkSession, to: Layers, as_of: datetime) -> DataFrame:
    return medallion.dashboard_revenue(spark.table(f"{to.gold}.daily_revenue"), as_of)


def run(
    spark: SparkSession,
    events_path: str,
    users_path: str,
    as_of: datetime,
    to: Layers = Layers(),
    window_minutes: int = medallion.SESSION_WINDOW_MINUTES,
    schema=landing.EVENTS,
) -> DataFrame:
    """All layers in order; returns the dashboard. Landing events are read by ``schema``, once;
    None infers it, with times as text."""
    ingest_raw_events(spark, events_path, to, ingested_at=as_of, schema=schema)
    ingest_users(spark, users_path, to)
    refresh_sessions(spark, to, as_of, window_minutes)
    refresh_users(spark, to)
    refresh_gold(spark, to)
    return dashboard(spark, to, as_of)
