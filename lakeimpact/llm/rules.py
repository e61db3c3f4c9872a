"""Quality rules: plain counts per text, and how far a text is from its language.

Two histograms of a text, of character classes and of common words, are compared with those of its
language by the Jensen-Shannon distance (in bits, 0 to 1). The languages' histograms are
counted over all documents. Everything is a column expression; texts are never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch
from .common import SPACES, WORDS

# The signs that count as symbols, and the classes; a character is of the first that it fits.
SYMBOLS = r"[#*$%&|<>]"
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", SPACES, r"[.,;:!?'\x22()-]+")
LETTERS = r"\p{L}+"
NO_LANGUAGE = "und"

COMMON = 32  # words in the histogram of a language
LEAST_WORDS, LEAST_CHARACTERS = 100, 200  # a shorter text is not judged by that histogram
LEAST_KNOWN = 1000  # words a language needs to be a reference
MOST_WORD_DISTANCE, MOST_CLASS_DISTANCE = 0.45, 0.33


def class_rests(text: Column) -> list[Column]:
    """The text, and what is left of it after each class. What a class took is gone for the next one, so only
    the first passes see the whole text."""
    rests = [text]
    for pattern in CLASSES:
        rests.append(F.regexp_replace(rests[-1], pattern, ""))
    return rests


def class_counts(text: Column) -> Column:
    """Characters of each class, and of none."""
    sizes = [F.length(r).cast("bigint") for r in class_rests(text)]
    return F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of one length, in bits."""

    def part(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return sum((F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0) / 2 for x in (a, b)), F.lit(0.0))

    # Rounding can leave equal histograms a little below zero.
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda total, one: total + one), F.lit(0.0)))


def references(docs: DataFrame, work: Scratch, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language with enough words: language, common (its most frequent words, ties by code point),
    longest (bytes of the longest of them), word_shares (theirs, then the rest's) and class_shares."""
    language = F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("language")
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(language, F.explode(letter_words(body)).alias("word")).groupBy("language", "word").count()
    counted = work.cut(counted, "words")
    known = counted.groupBy("language").agg(F.sum("count").alias("known")).filter(F.col("known") >= LEAST_KNOWN)
    # At most COMMON rows of a language leave a partition.
    by_count = Window.partitionBy("language").orderBy(F.desc("count"), "word")
    top = counted.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= COMMON)
    words = top.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "word", "count"))).alias("top"))

    sums = docs.select(language, class_counts(body).alias("n")).groupBy("language")
    classes = sums.agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(CLASSES) + 1)]).alias("classes"))
    every = F.aggregate("classes", F.lit(0).cast("bigint"), lambda total, n: total + n)
    shares = F.transform("top.count", lambda n: n / F.col("known"))
    rest = F.aggregate("top.count", F.col("known"), lambda left, n: left - n) / F.col("known")
    found = known.join(words, "language").join(classes, "language")
    return work.cut(
        found.select(
            "language",
            F.col("top.word").alias("common"),
            F.array_max(F.transform("top.word", lambda w: F.octet_length(w))).alias("longest"),
            F.concat(shares, F.array(rest)).alias("word_shares"),
            F.transform("classes", lambda n: n / every).alias("class_shares"),
        ),
        "references",
    )


def _counted(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """The plain counts. A column that a later expression looks into element by element is named twice there,
    so that it is computed once per text."""
    body, n = F.col("_text"), F.size("_words")
    # No class takes a symbol, so all of them are in the little that the classes leave.
    symbols = F.regexp_count(class_rests(body)[-1], F.lit(SYMBOLS)).cast("bigint")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("language"),
    ).withColumns({"_words": F.regexp_extract_all(body, F.lit(WORDS), F.lit(0)), "_classes": class_counts(body), "_symbols": symbols})

    def window(word: Column, i: Column) -> Column:
        return F.xxhash64(word, F.get("_words", i + 1), F.get("_words", i + 2))

    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORDS))
    rows = rows.select(
        "doc_id",
        "language",
        "_text",
        n.cast("bigint").alias("n_words"),
        (F.length(body) - F.col("_classes")[CLASSES.index(SPACES)]).alias("word_chars"),
        "_classes",
        F.col("_symbols").alias("n_symbols"),
        lines.alias("_lines"),
        # Over the words themselves; the last two begin no window.
        F.when(n >= 3, F.slice(F.transform("_words", window), F.lit(1), n - 2)).alias("_hashes"),
    )
    # Most texts have no window twice; only the others have theirs sorted.
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_windows", F.when(some, placed)).drop("_hashes")
    # Equal windows are neighbours now. A window adds the words that the one before it did not cover.
    own = rows.withColumn("_n_lines", F.size("_lines"))

    def repeated(x: Column, i: Column) -> Column:
        return F.coalesce(
            F.get("_windows", i - 1)["h"].eqNullSafe(x["h"]) | F.get("_windows", i + 1)["h"].eqNullSafe(x["h"]), F.lit(False)
        )

    places = F.sort_array(F.transform(F.filter("_windows", repeated), lambda x: x["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("held")),
        lambda seen, at: F.struct(at.alias("last"), (seen["held"] + F.least(at - seen["last"], F.lit(3))).alias("held")),
        lambda seen: seen["held"],
    )
    return own.select(
        "doc_id",
        "language",
        "_text",
        "_classes",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most_words: float = MOST_WORD_DISTANCE,
    most_classes: float = MOST_CLASS_DISTANCE,
) -> DataFrame:
    """One row per input row: doc_id, the counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words),
    base_failed, word_distance, class_distance and kept.

    Base rules: at least 50 words, at most half of them in three-word windows that the text has twice or more. Kept
    is what passes them and is not further from its language than ``most_words`` and ``most_classes``.
    A distance is null, and does not count, where the text has under 100 words of letters (200 characters
    for the classes) or its language under 1,000 words in all documents. A null language is a language of its own
    (``und``), null texts are empty ones and fail the base rules, rows that repeat are rows of their own, and so
    are those of a null id. Texts are looked at whole, however long. Windows are compared by 64-bit hashes within
    one text. Other columns are ignored. No rows give no rows.
    """
    known = references(docs, Scratch(docs.sparkSession, "rules"), text, lang)
    told = _counted(docs, doc_id, text, lang).join(known, "language", "left")
    told = told.withColumn("_tokens", letter_words(F.col("_text")))
    short = lambda t: F.octet_length(t) <= F.col("longest")  # noqa: E731  (most words are longer than all common ones)
    told = told.withColumns(
        {
            "_found": F.array_remove(F.transform(F.filter("_tokens", short), lambda t: F.array_position("common", t)), F.lit(0).cast("bigint")),
            "_n": F.size("_tokens"),
            "_all": F.aggregate("_classes", F.lit(0).cast("bigint"), lambda total, n: total + n),
        }
    )
    # One loop of compiled code per common word, without an array of them all.
    each = F.array(*[F.size("_found") - F.size(F.array_remove("_found", F.lit(k).cast("bigint"))) for k in range(1, COMMON + 1)])
    held = F.concat(F.slice(each, 1, F.size("common")), F.array(F.col("_n") - F.size("_found")))
    enough = (F.col("_n") >= LEAST_WORDS) & F.col("common").isNotNull()
    by_words = F.when(enough, distance(F.transform(held, lambda n: n / F.col("_n")), F.col("word_shares")))
    enough = (F.col("_all") >= LEAST_CHARACTERS) & F.col("common").isNotNull()
    by_classes = F.when(enough, distance(F.transform("_classes", lambda n: n / F.col("_all")), F.col("class_shares")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = told.select(
        "doc_id",
        *counts,
        failed.alias("base_failed"),
        F.round(by_words, 6).alias("word_distance"),
        F.round(by_classes, 6).alias("class_distance"),
    )
    far = F.coalesce(F.col("word_distance") > most_words, F.lit(False)) | F.coalesce(F.col("class_distance") > most_classes, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
