"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where its own content says so, each distinct chunk gets one
verified identifier, and texts are compared as ordered lists of identifiers. Chunks travel
once (equal ones are merged before the shuffle); documents themselves never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch
from .common import SPACES

# At least 512 characters, then up to the first word that ends in one of four letters;
# 4,096 characters at most, so that a text without spaces is cut as well.
CHUNK = r"(?s).{512,4094}?[nteo] |.{1,4096}"


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: str = CHUNK,
    fingerprint=F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after each run of ASCII white space became one blank; null
    counts as empty. ``keep_id`` is the smallest non-null doc_id of the group. Rows that repeat
    the kept doc_id with an equal text are the same document and all marked kept; a null
    doc_id is kept only in a group without any other id. Other columns are ignored.

    A chunk's identifier is its fingerprint plus an ordinal that tells different chunks of one
    fingerprint apart: every distinct chunk meets all others of its fingerprint, so equal
    identifiers mean equal bytes.
    """
    work = Scratch(docs.sparkSession, "exact-dedup")
    cut = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("_text")).withColumn(
        "_chunks", F.regexp_extract_all("_text", F.lit(chunk), F.lit(0))
    )
    recipes = work.cut(
        cut.select(
            "doc_id",
            F.transform("_chunks", lambda c: fingerprint(c)).alias("recipe"),
            F.sha2("_text", 256).alias("text_sha256"),
        ),
        "recipes",
    )

    # Every distinct chunk, merged before and after the exchange; usually no fingerprint has two.
    pieces = cut.select(F.explode("_chunks").alias("chunk")).select(fingerprint("chunk").alias("fp"), "chunk")
    distinct = pieces.groupBy("fp", "chunk").agg(F.lit(1).alias("one"))
    shared = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if work.write(shared, "shared"):
        recipes = _told_apart(work, cut, recipes, distinct, fingerprint)

    groups = work.cut(
        recipes.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "groups",
    )
    # Both sides come straight from tables, so a recipe of very many copies is split at run time.
    found = recipes.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("bigint").alias("n_chunks"),
    )


def _told_apart(work: Scratch, cut: DataFrame, recipes: DataFrame, distinct: DataFrame, fingerprint):
    """Recipes with (fingerprint, ordinal) where different chunks share a fingerprint."""
    shared = work.read("shared", "fp bigint, n bigint").select("fp")
    ordered = Window.partitionBy("fp").orderBy("chunk")
    names = work.cut(
        distinct.join(shared, "fp").select("fp", "chunk", F.row_number().over(ordered).alias("ordinal")), "names"
    ).filter("ordinal > 1")
    # Texts are rows here, not doc_ids: the digest of the text is the key.
    spots = cut.select(
        F.sha2("_text", 256).alias("text_sha256"), F.posexplode(F.array_distinct("_chunks")).alias("_n", "chunk")
    ).withColumn("fp", fingerprint("chunk"))
    renamed = (
        spots.join(names, ["fp", "chunk"])
        .select("text_sha256", F.struct("chunk", "ordinal").alias("name"))
        .distinct()
        .groupBy("text_sha256")
        .agg(F.collect_list("name").alias("_names"))
    )
    ordinals = (
        cut.select(F.sha2("_text", 256).alias("text_sha256"), "_chunks")
        .join(renamed, "text_sha256")
        .select(
            "text_sha256",
            F.transform(
                "_chunks",
                lambda c: F.coalesce(
                    F.try_element_at(F.map_from_entries("_names"), c).cast("bigint"), F.lit(1).cast("bigint")
                ),
            ).alias("_ordinals"),
        )
        .dropDuplicates(["text_sha256"])
    )
    joined = recipes.join(ordinals, "text_sha256", "left")
    return work.cut(
        joined.select(
            "doc_id",
            F.when(F.col("_ordinals").isNull(), F.col("recipe"))
            .otherwise(F.concat("recipe", "_ordinals"))
            .alias("recipe"),
            "text_sha256",
        ),
        "told-apart",
    )


def dropped(docs: DataFrame, **columns) -> DataFrame:
    """The doc_ids that exact_dedup removes."""
    return exact_dedup(docs, **columns).filter(~F.col("kept")).select("doc_id")
