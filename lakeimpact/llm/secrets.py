"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters inside a word, with padding but no other `=` in it, or a shorter
one of at least 8 that a credential's name is assigned. The forest looks at its length, how its
characters change class, how much of it the corpus' own words cover, the path (source) of its
document and the neighbouring words, and learns from labelled findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .common import SPACES

_KEY = r"[A-Za-z0-9+/_\-]"
_PADDING = rf"(?:={{1,2}}(?!{_KEY}))?"  # an equals sign before a key character assigns
CANDIDATE = rf"(?:{_KEY}{{16,}}{_PADDING}|{_KEY}{{15}}=(?!{_KEY})|{_KEY}{{14}}==(?!{_KEY}))"
SHORT = rf"{_KEY}{{8,}}{_PADDING}"
_NAMES = r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|credential)s?[\"']?"
CREDENTIAL = _NAMES + "[:=]?$"
ASSIGNS = _NAMES + r"[:=]+[\"'(]*"
PLACEHOLDER = r"(?i)example|dummy|changeme|placeholder|x{6,}|your[_-]"
NEIGHBOURS = ("before", "before2", "after")
FEATURES = ["length", "digits", "uppers", "changes", "variety", "covered", "path_odds", *(f"{n}_odds" for n in NEIGHBOURS)]


def candidates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", held_out: Column | None = None
) -> DataFrame:
    """doc_id, path, held_out, word_no (from 0), run_no, candidate, before2, before, after: all candidates of the whole text."""
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")), " ")
    shaped = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), words.alias("_w"))
    word = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    after_name = lambda i: F.concat(word(i - 2), word(i - 1)).rlike(ASSIGNS + "$")
    short = lambda i: F.get("_w", i).rlike(ASSIGNS + SHORT) | (F.get("_w", i).rlike(SHORT) & after_name(i))
    at = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).rlike(CANDIDATE) | short(i))
    found = F.transform(
        at,
        lambda i: F.struct(
            i.alias("word_no"), word(i).alias("word"), word(i - 2).alias("before2"), word(i - 1).alias("before"), word(i + 1).alias("after"), short(i).alias("short")
        ),
    )
    each = shaped.select("doc_id", "path", "held_out", F.explode(found).alias("x")).select("doc_id", "path", "held_out", "x.*")
    pick = lambda pattern: (F.regexp_extract_all("word", F.lit(pattern), F.lit(0)), F.split("word", pattern))
    (some, apart), (many, narrow) = pick(CANDIDATE), pick(SHORT)
    each = each.withColumn("runs", F.when(F.col("short"), many).otherwise(some)).withColumn("gaps", F.when(F.col("short"), narrow).otherwise(apart))
    # What stands between a run and the one before it; the first run has what the word begins with.
    runs = F.transform(
        "runs",
        lambda run, k: F.struct(run.alias("candidate"), F.concat(F.when(k > 0, F.get("runs", k - 1)).otherwise(F.lit("")), F.get("gaps", k)).alias("lead")),
    )
    each = each.select("doc_id", "path", "held_out", "word_no", F.posexplode(runs).alias("run_no", "run"), "before2", "before", "after")
    each = each.select("doc_id", "path", "held_out", "word_no", "run_no", "run.*", "before2", "before", "after")
    # A name that assigns the run in the same word is the word before it; any other lead belongs to the one before.
    name = F.regexp_extract("lead", r"[A-Za-z0-9_.\-]+[\"'\])]*[:=]+[\"'(\[{]*$", 0)
    named = name != ""
    led = each.select(
        "doc_id", "path", "held_out", "word_no", "run_no", "candidate",
        F.when(named, F.col("before")).otherwise(F.col("before2")).alias("before2"),
        F.when(named, name).otherwise(F.concat("before", "lead")).alias("before"), "after",
    )
    assigned = F.when(F.col("before").rlike("[A-Za-z]"), F.col("before")).otherwise(F.concat("before2", "before")).rlike(ASSIGNS + "$")
    return led.filter(F.col("candidate").rlike("^" + CANDIDATE) | assigned)


def _known_words(docs: DataFrame, parts: DataFrame, text: str, least: int) -> DataFrame:
    """The parts that are words of at least ``least`` documents, counted over all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?<![^\x20\x09-\x0D])[a-z]{3,}(?![a-z0-9])"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    return counted.filter(F.col("held") >= least).join(parts, "part", "left_semi").select("part")


def _features(docs: DataFrame, found: DataFrame, work: Scratch, text: str, least: int) -> DataFrame:
    """Adds what depends on the candidate alone."""
    distinct = found.select("candidate").distinct()
    piece = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))))
    pieces = work.cut(distinct.select("candidate", piece.alias("part")), "pieces")
    known = work.cut(_known_words(docs, pieces.select("part").distinct(), text, least), "known")
    covered = pieces.join(known, "part").groupBy("candidate").agg(F.sum(F.length("part")).alias("_known"))
    covered = work.cut(covered, "covered")
    size = F.length("candidate")
    share = lambda drop: (size - F.length(F.regexp_replace("candidate", drop, ""))) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    return found.join(covered, "candidate", "left").select(
        found["*"],
        size.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        (F.length(kinds) / size).alias("changes"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("variety"),
        F.least(F.lit(1.0), F.coalesce("_known", F.lit(0)) / size).alias("covered"),
    )


FOLDS = 5


def _with_odds(rows: DataFrame, learned: DataFrame, work: Scratch) -> DataFrame:
    """Adds, for path and neighbours, the smoothed log odds of a secret among the learned findings of other documents.

    Documents are in folds; a finding that is learned from has the odds of the other folds, so that its own
    label is not among what the forest is told about it.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    # Findings that are not learned from are in no fold, and nothing is taken off for them.
    rows = rows.withColumn("_fold", F.when(~F.col("held_out") & F.col("label").isNotNull(), fold).otherwise(-1))
    word = lambda c: F.lower(F.regexp_replace(c, r"[\"'(),.;]", ""))
    keys = {"path": F.col("path"), **{n: word(F.col(n)) for n in NEIGHBOURS}}
    for name, key in keys.items():
        sums = learned.groupBy(key.alias(f"_{name}"), fold.alias("_fold")).agg(
            F.sum("label").alias("_yes"), F.sum(1 - F.col("label")).alias("_no")
        )
        sums = work.cut(sums, f"sums-{name}")
        both = sums.groupBy(f"_{name}").agg(F.sum("_yes").alias("_all_yes"), F.sum("_no").alias("_all_no"))
        both = work.cut(both, f"odds-{name}")
        left = lambda every, own: F.col(every) - F.coalesce(own, F.lit(0)) + 0.5
        odds = F.coalesce(F.log(left("_all_yes", "_yes") / left("_all_no", "_no")), F.lit(0.0)).alias(f"{name}_odds")
        held = rows.columns
        rows = rows.withColumn(f"_{name}", key).join(both, f"_{name}", "left").join(sums, [f"_{name}", "_fold"], "left")
        rows = rows.select(*held, odds)
    return rows.drop("_fold")


def weak_label(before2: Column, before: Column, candidate: Column) -> Column:
    """A finding counts as a secret where a credential's name is assigned it and it is no placeholder.

    Stands in for reviewed findings where there are none.
    """
    named = F.regexp_replace(F.concat_ws("", before2, F.regexp_replace(before, r"[\"'(]+$", "")), r"[:=]+$", "").rlike(CREDENTIAL)
    assigned = before.rlike(r"[:=][\"']?$")
    return (named & assigned & candidate.rlike("[0-9]") & ~candidate.rlike(PLACEHOLDER)).cast("int")


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str = "source",
    held_out: Column | None = None,
    most: int = 50_000,
    least_docs: int = 3,
    cut: float = 0.5,
) -> DataFrame:
    """One row per candidate: doc_id, word_no, run_no, length, candidate_sha256, label, held_out, score, is_secret.

    ``labelled`` has (doc_id, word_no, run_no, label 0 or 1) of reviewed findings; without it ``weak_label`` is
    taken. Findings of documents for which ``held_out`` is true are never learned from. The forest is fitted on at
    most about ``most`` findings chosen by hash; odds and word counts cover all. With one label only, all
    scores are that label. Null texts have no candidates; a null path is an empty one. Repeated rows give repeated
    findings. Secrets themselves are not in the result.
    """
    work = Scratch(docs.sparkSession, "secrets")
    found = candidates(docs, doc_id, text, path, held_out)
    found = work.cut(found, "found")
    if labelled is None:
        found = found.withColumn("label", weak_label(F.col("before2"), F.col("before"), F.col("candidate")))
    else:
        told = labelled.select("doc_id", "word_no", "run_no", F.col("label").cast("int").alias("label")).distinct()
        found = found.join(told, ["doc_id", "word_no", "run_no"], "left")
    rows = work.cut(_features(docs, found, work, text, least_docs), "features")
    learned = rows.filter("not held_out and label is not null")
    ready = work.cut(_with_odds(rows, learned, work), "ready")
    usable = ready.filter("not held_out and label is not null")
    counts = usable.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    held_by = {label: n for label, n in enumerate(counts) if n}
    named = ["doc_id", "word_no", "run_no", F.col("length").cast("int").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "label", "held_out"]
    if len(held_by) < 2:
        only = float(next(iter(held_by), 0))
        return ready.select(*named, F.lit(only).alias("score"), F.lit(only >= cut).alias("is_secret"))
    total = sum(held_by.values())
    draw = F.pmod(F.xxhash64("doc_id", "word_no", "run_no"), F.lit(1 << 20)) / float(1 << 20)
    # Both labels are learned from alike: half of the sample each, as far as there is enough.
    wanted = reduce(
        lambda c, kv: F.when(F.col("label") == kv[0], min(1.0, most / 2 / kv[1])).otherwise(c), held_by.items(), F.lit(0.0)
    )
    weight = reduce(lambda c, kv: F.when(F.col("label") == kv[0], total / (2.0 * kv[1])).otherwise(c), held_by.items(), F.lit(1.0))
    sample = work.cut(usable.filter(draw < wanted).withColumn("weight", weight).select("label", "weight", *FEATURES), "sample")
    shape = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=24, maxDepth=6, seed=5, probabilityCol="p")
    # Stored and read again: the fitted object holds its training summary and with it the session.
    forest.fit(shape.transform(sample)).write().save(f"{work.root}/forest")
    model = RandomForestClassificationModel.load(f"{work.root}/forest")
    scored = model.transform(shape.transform(ready)).withColumn("score", vector_to_array("p").getItem(1))
    return scored.select(*named, "score", (F.col("score") >= cut).alias("is_secret"))
