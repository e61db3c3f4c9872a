"""Positions within a group, without gathering the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch


def rank_within(
    df: DataFrame, group: list[str], order: list[str], name: str, work: Scratch | None = None
) -> DataFrame:
    """Add the 1-based position of each row within its group.

    ``row_number`` over the group would sort the whole group in one task. Here rows are
    spread by range over (group, order), numbered inside their partition, and shifted by
    what earlier partitions hold of the same group: one small row per partition and group.
    The rows are stored in between, as another evaluation could cut the ranges elsewhere.
    ``order`` has to be unique within a group. The rows are stored in ``work`` where it is given, so that
    its owner can delete them.
    """
    place = "_place"
    part = F.shiftright(place, 33)
    ranged = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn(place, F.monotonically_increasing_id())
    )
    work = work or Scratch(df.sparkSession, "rank")
    stored = work.cut(ranged, f"ranked-{name.strip('_')}").withColumn("_part", part)
    held = stored.groupBy(*group, "_part").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_held")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    return (
        stored.join(offsets, [*group, "_part"])
        .withColumn(name, (F.col(place) + F.col("_shift")).cast("bigint"))
        .select(*df.columns, name)
    )


# A window sorts so many rows in one task without trouble.
LARGEST_GROUP = 1 << 20
BINS = 1 << 16


def rank_within_many(
    df: DataFrame, group: list[str], order: list[str], name: str, work: Scratch, largest: int = LARGEST_GROUP
) -> DataFrame:
    """:func:`rank_within` where there are many groups, most of them small: these are exchanged once and numbered
    where they arrive.

    Groups are counted by the bin that their hash falls in, so that the counts stay few. Bins of more than
    ``largest`` rows go through :func:`rank_within`. ``df`` is read more than once.
    """
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(*group), F.lit(BINS)))
    counts = binned.groupBy("_bin").count().where(F.col("count") > largest).select("_bin")
    large = work.write(counts, "large")
    if not large:
        return df.withColumn(name, number)
    counts = work.read("large", counts.schema)
    few = binned.join(counts, "_bin", "left_anti").select(*df.columns).withColumn(name, number)
    many = binned.join(counts, "_bin", "left_semi").select(*df.columns)
    return few.unionByName(rank_within(many, group, order, name, work))
