"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import rank_within
from ..session import Scratch
from .common import WORDS

MOST = 3


def targets(sources: DataFrame, most: int = MOST, cycle: int = 3) -> DataFrame:
    """source_key, source_size -> with weight and target: words each source should give.

    Sources by code point, null last, weigh 1, 2, .. ``cycle``, repeating. Targets add up to
    all words; one above ``most`` times its source's size stops there, and the excess goes to the
    others by weight until none is above. Sorted by size per weight, the capped sources
    come first, so one pass over the sources (one row each) finds the level.
    """
    named = Window.orderBy("source_key")
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        sources.withColumn("weight", (F.row_number().over(named) - 1) % cycle + 1)
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("_weights", F.sum("weight").over(rest))
        .withColumn("_share", F.col("_left").cast("double") * F.col("weight") / F.col("_weights"))
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_free", F.col("_share") < F.col("_cap"))
        # The level is set where the first source stays below its cap.
        .withColumn("_at", F.min(F.when(F.col("_free"), F.struct(F.col("source_size") / F.col("weight"), "source_key", "_left", "_weights"))).over(everything))
    )
    free = F.col("_at._left").cast("double") * F.col("weight") / F.col("_at._weights")
    return level.select(
        "source_key",
        "source_size",
        "weight",
        F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", free)).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    most: int = MOST,
    cycle: int = 3,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, source.

    Size counts words (null text: 0). Every document of a source expects target / source_size
    copies; running over the source in order of (size, doc_id), from one offset drawn for the
    source, a copy is emitted for each integer the prefix sum crosses: the rounded-down
    or rounded-up expectation, never above ``most``. In order of size, neighbours stand in for one
    another, so taken words stay within about the largest document of the target.
    A null source is a source of its own. Repeated rows are rows of their own. A source
    without words has target 0 and gives nothing. Same input, same result.
    """
    work = Scratch(docs.sparkSession, "mixing")
    key = F.struct(F.col(source).isNull().alias("missing"), F.coalesce(F.col(source), F.lit("")).alias("name"))
    sized = work.cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("bigint").alias("size"),
            key.alias("source_key"),
        ),
        "sized",
    )
    sums = work.cut(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), "sources")
    share = targets(sums, most, cycle)
    # Sixteen-bit steps off the integers: sums of whole expectations never meet a boundary.
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key.missing").cast("string"), F.lit(":"), F.col("source_key.name"))), 1, 3), 16, 10)
    offset = (drawn.cast("double") + 0.5) / 4096
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = share.select("source_key", "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    ranked = rank_within(sized.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))), ["source_key"], ["size", "_id"], "_n", work)
    crossed = F.floor(F.col("_rate") * F.col("_n") + F.col("_offset")) - F.floor(
        F.col("_rate") * (F.col("_n") - 1) + F.col("_offset")
    )
    return ranked.join(share, "source_key").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (crossed * F.col("size")).cast("bigint").alias("taken"),
        crossed.cast("int").alias("copies"),
        F.when(~F.col("source_key.missing"), F.col("source_key.name")).alias("source"),
    )
