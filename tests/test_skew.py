"""A third of all rows under one key: results stay whole and the work is split."""

import pytest
from pyspark.sql import functions as F

from lakeimpact.operators import columns, graph, medallion, overlay
from lakeimpact.session import apply_settings, scratch_root

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def no_broadcast(spark):
    """Sizes scaled down so that the runtime meets in kilobytes what a cluster meets in gigabytes."""
    before = {k: spark.conf.get(k, None) for k in CONF}
    apply_settings(spark)
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_user_is_split_in_the_join(no_broadcast):
    spark = no_broadcast
    sessions = spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user_id"),
        F.concat(F.lit("session-"), F.col("id")).alias("session_id"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("started_at"),
        F.lit(1.0).alias("revenue"),
    )
    users = spark.range(60_000).select(
        F.col("id").alias("user_id"), F.when(F.col("id") == 7, "hot").otherwise("cold").alias("plan_tier")
    )
    df = medallion.daily_revenue(sessions, users)
    assert {r["plan_tier"]: (r["revenue"], r["sessions"]) for r in df.collect()} == {
        "hot": (20_001.0, 20_001) if 7 % 3 else (20_000.0, 20_000),
        "cold": (39_999.0, 39_999) if 7 % 3 else (40_000.0, 40_000),
    }
    assert "skew=true" in final_plan(df)


def test_hot_table_is_split_in_the_column_check(no_broadcast):
    spark = no_broadcast
    texts = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("change_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("table_name"),
        F.concat(F.lit("SELECT a, x"), F.col("id")).alias("text"),
    )
    catalog = spark.range(20_000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("table_name"),
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column_name"),
        F.lit("int").alias("data_type"),
        F.lit(0).alias("ordinal"),
    )
    df = columns.dropped_columns(texts, catalog)
    assert df.groupBy("column_name").count().collect() == [("b", 20_000)]
    assert "skew=true" in final_plan(df)


def test_hot_file(spark):
    """One file with a third of all references and symbols, many of them on one range."""
    refs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot.py").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("file_path"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).cast("int").alias("line"),
    )
    symbols = spark.range(30_000).select(
        F.concat(F.lit("s"), F.col("id")).alias("id"),
        F.lit("n").alias("name"),
        F.when(F.col("id") % 3 == 0, "hot.py").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("file_path"),
        F.when(F.col("id") % 6 == 0, F.col("id")).otherwise(1).cast("int").alias("start_line"),
        F.when(F.col("id") % 6 == 0, F.col("id") + 1).otherwise(40_000).cast("int").alias("end_line"),
        F.col("id").alias("ordinal"),
    )
    got = overlay.ref_owner(refs, symbols)
    assert got.count() == 30_000
    hot = {r["line"]: r["owner_id"] for r in got.where("file_path = 'hot.py'").collect()}
    # Line 0 is in the range 0..1 only; every sixth line starts a range, the others lie in
    # the 5,000 equal ranges, of which the first one counts.
    assert hot == {n: f"s{n}" if n % 6 == 0 else "s3" for n in range(0, 30_000, 3)}


def test_hub_table_in_the_walk(spark):
    """A table that a third of all jobs read: its readers never multiply with its writers."""
    n = 3000
    edges = spark.range(n).select(
        F.concat(F.lit("job"), F.col("id")).alias("from_id"),
        F.explode(
            F.array(
                F.struct(
                    F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("a"), F.col("id"))).alias("table_name"),
                    F.lit("READS_TABLE").alias("type"),
                ),
                F.struct(F.concat(F.lit("b"), F.col("id")).alias("table_name"), F.lit("WRITES_TABLE").alias("type")),
            )
        ).alias("e"),
    ).select("from_id", "e.*").union(spark.sql("SELECT 'job1', 'hub', 'WRITES_TABLE'"))
    starts = spark.createDataFrame([("hub",), ("a1",)], "start string")
    found = graph.blast_radius(starts, *graph.links(edges))
    assert {(r[0], r[1]): r[2] for r in found.groupBy("start_table", "depth").count().collect()} == {
        ("hub", 1): 1000, ("a1", 1): 2, ("a1", 2): 1000,
    }


def test_hot_scope_is_not_multiplied(spark):
    """One function that reads a third of all tables, in one long file."""
    n, lines = 2000, 3000
    text = "\n".join(f"use c{i % 50}" for i in range(lines))
    sources = spark.createDataFrame([("hot.py", text)], "file_path string, text string")
    edges = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("table_name"),
        F.lit("READS_TABLE").alias("type"),
        F.lit("hot.py").alias("file_path"),
        F.lit("hot.py::f").alias("owner_id"),
        F.lit("f").alias("owner_name"),
        F.lit(1).alias("owner_start"),
        F.lit(lines).alias("owner_end"),
    )
    catalog = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("table_name"),
        F.concat(F.lit("c"), F.col("id") % 60).alias("column_name"),
        F.lit("int").alias("data_type"),
        F.lit(0).alias("ordinal"),
    )
    got = columns.reader_mentions(edges, sources, catalog)
    assert got.count() == sum(i % 60 < 50 for i in range(n))


def test_scratch_folder_is_the_shared_one(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")

    # Without the setting the folder lies below the warehouse, whatever the master.
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, *_: {"spark.sql.warehouse.dir": "store:/lake/"}.get(key))

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    for master in ("local[2]", "yarn"):
        Unset.sparkContext.master = master
        assert scratch_root(Unset) == "store:/lake/_scratch"
