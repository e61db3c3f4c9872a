"""A corpus pipeline: language, exact and near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as
the next one's docs; all but the last return the columns of documents, whatever their names. A doc_id stands
for one document: where rows repeat an id, a stage that drops the id drops its rows. Rows of a null id are
never taken for copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeimpact.llm import bpe, exact_dedup, langid, mixing, near_dup
from lakeimpact.llm.common import prepare, table
from lakeimpact.llm.registry import RANK_FILE, public_tokenizers
from lakeimpact.session import Owned, Scratch

# Matches that a worker of the last stage remembers: there, the executor still holds what earlier stages took.
REMEMBERED = 400_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns _c0, _c1, .., which clash with no other name, and the number of each name."""
    numbered = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*numbered), dict(zip(docs.columns, numbered))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among those of ``gone``."""
    rows, name = _numbered(docs)
    left = rows.join(gone.select("doc_id").distinct(), F.col(name["doc_id"]) == F.col("doc_id"), "left_anti")
    return left.toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language: rejects texts that are null or have no letter, and ambiguous ones."""
    prepare(spark)
    rows, name = _numbered(docs)
    told = {"doc_id": name["doc_id"], "text": name["text"]}
    model = langid.train(rows.filter(~langid.held_out(name["doc_id"])), **told, lang=name["lang"])
    said = langid.identify(rows, model, **told, keep={c: F.col(c) for c in rows.columns})
    kept = said.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*rows.columns).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts."""
    prepare(spark)
    rows, name = _numbered(docs)
    return _without(docs, exact_dedup.dropped(rows, doc_id=name["doc_id"], text=name["text"]))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id."""
    prepare(spark)
    rows, name = _numbered(docs)
    found = near_dup.near_duplicates(rows, name["doc_id"], name["text"])
    return _without(docs, found.filter(~F.col("kept")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Rows that repeat an id get an even share of its copies, rounded.
    """
    prepare(spark)
    rows, name = _numbered(docs)
    mixed = mixing.mix_sources(rows, name["doc_id"], name["text"], name["source"])
    least = F.lit(-(2**63))
    copies = mixed.groupBy(F.coalesce("doc_id", least).alias("_key")).agg(F.round(F.avg("copies")).cast("int").alias("_copies"))
    keyed = rows.withColumn("_key", F.coalesce(name["doc_id"], least))
    taken = keyed.join(copies.filter("_copies > 0"), "_key")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*rows.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row, encoded and decoded again."""
    prepare(spark)
    rows, name = _numbered(docs)
    rows = rows.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"))
    return bpe.encode_decode(rows, RANK_FILE, public_tokenizers.PATTERN, remembered=REMEMBERED)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix_sources", mixture),
    ("bpe", tokens),
]

# Neither the classifier of the first stage nor the merges of the last can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's rows are a table of the shared folder; it is deleted when
    the next one is written, and so is all that a stage stored on the way."""
    docs = table(spark, sf_dir, "documents")
    work = Scratch(spark, "corpus-pipeline")
    former = None
    for name, stage in STAGES:
        with Owned() as stored:
            docs = work.cut(stage(spark, docs, sf_dir), name)
        stored.release()
        if former:
            work.drop(former)
        former = name
    return docs
