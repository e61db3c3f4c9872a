"""Phrase collocations by best-first branch-and-bound growth.

A phrase is counted only where it can matter. Whatever cut a phrase has after its first word (before its last),
the other part occurs at least as often as the phrase itself, so its score is at most 1000 n / f(first word)
(1000 n / f(last word)): rare words promise most and the bound of a word holds for everything grown from it. The
frontier of a language is its words in order of that bound. Each wave takes the best of them, grows all phrases that
start or end with one by a word at a time, and scores those that do both, as their parts and all their
extensions by a word are then counted too. A language is settled when no word left promises as much as its
last place has; ties are below that only if the bound is.

A step of growth is one pass over the corpus; from four words on it grows by two. It knows the words and the phrases of the step before from
filters of fixed size, so it may count phrases too many, never too few; counts themselves are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch
from .bitfilter import Filter, bits_for, filter_from, place_of
from .common import gram_hashes, mix, word_hashes

LEAST, LONGEST, BEST = 100, 5, 2000
NO_LANGUAGE = "und"
FIRST_SHARE = 8  # the first wave takes the words that make up the rarest eighth of a language's words

BREAK = b"A"  # stands for the end of a piece, as no text has an A any more
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d" + b"\t", bytes(range(97, 123)) + BREAK * 10 + b" "
)
PIECE, TOGETHER = 4 << 20, 1 << 20  # bytes of a text and tokens that are looked at together
MOST_CODES = 300_000  # words whose codes or counts a task keeps from one stretch to the next


def token_lists(body: bytes, ahead: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and breaks of a text, in stretches that have up to ``ahead`` tokens of the next one at their end;
    with the number of tokens that are the stretch's own."""
    body = body.translate(_PLAIN).replace(BREAK, b" A ")
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        if end < 0:
            own = body[at:].split()
            yield own + [BREAK], len(own)
            return
        own, reach = body[at:end].split(), 1 << 12
        while True:  # enough text for the tokens ahead, the last of which has to be whole
            after = body[end : end + reach].split()
            if len(after) > ahead or end + reach >= len(body):
                break
            reach *= 2
        yield own + after[:ahead] + [BREAK], len(own)
        at = end


def _salts(languages: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(name.encode()) for name in languages), np.uint64, len(languages))


_BREAK_HASH = np.uint64(xxhash.xxh3_64_intdigest(BREAK))


def phrase_hashes(languages: list[str], phrases: list[str]) -> np.ndarray:
    """The hashes that phrases of one length have in all steps; they differ by language."""
    words = [p.encode().split(b" ") for p in phrases]
    if not words:
        return np.empty(0, np.uint64)
    size = len(words[0])
    flat = word_hashes([w for phrase in words for w in phrase])
    flat = mix(flat ^ np.repeat(_salts(languages), size))
    return gram_hashes(flat, size)[::size]


def filter_of(phrases: DataFrame, rows: int) -> Filter:
    """The filter of a table (lang, phrase) of phrases of one length."""
    bits = bits_for(rows)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = place_of(phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(place), pa.int64())], names=["place"])

    return filter_from(phrases.select("lang", "phrase").mapInArrow(places, "place bigint"), bits)


def _in_tokens(docs: DataFrame, ahead: int, counter) -> DataFrame:
    """(lang, phrase, a) of the texts (lang, body): what ``counter()`` counts in their tokens, summed.

    A counter takes (lang, tokens, own tokens) and says whether it is full; ``rows()`` empties it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()

        def rows() -> pa.RecordBatch:
            langs, phrases, held = count.rows()
            phrases = pa.array(phrases, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrases, pa.array(held, pa.int64())], names=["lang", "phrase", "held"])

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, own in token_lists(body.as_py(), ahead):
                    if count.add(lang, found, own):
                        yield rows()
        yield rows()

    found = docs.mapInArrow(run, "lang string, phrase string, held bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("held").alias("a"))


class Words:
    """Counts single words."""

    def __init__(self):
        self.held: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, found: list[bytes], own: int) -> bool:
        counted = self.held.setdefault(lang, Counter())
        before = len(counted)
        counted.update(found[:own])
        self.size += len(counted) - before
        return self.size >= MOST_CODES

    def rows(self) -> tuple[list, list, list]:
        langs, words, held = [], [], []
        for lang, counted in self.held.items():
            counted.pop(BREAK, None)
            langs += [lang] * len(counted)
            words += counted.keys()
            held += counted.values()
        self.held, self.size = {}, 0
        return langs, words, held


class Growth:
    """Counts the phrases of some sizes that start or end with a good word, and whose first (last) words, as
    many as the phrases counted the step before have, are one of those."""

    def __init__(self, sizes: tuple[int, ...], known: Filter, good: Filter, before: Filter):
        self.sizes, self.known, self.good, self.before = sizes, known, good, before
        self.tokens, self.parts, self.spans = [], [], []

    def add(self, lang: str, found: list[bytes], own: int) -> bool:
        self.parts.append(word_hashes(found))
        self.tokens += found
        self.spans.append((lang, len(found), own))
        return len(self.tokens) >= TOGETHER

    def rows(self) -> tuple[list, list, list]:
        tokens, parts, spans = self.tokens, self.parts, self.spans
        self.tokens, self.parts, self.spans = [], [], []
        out = [], [], []
        if not spans:
            return out
        names = [lang for lang, _, _ in spans]
        number = {lang: i for i, lang in enumerate(dict.fromkeys(names))}
        of_span = _salts(list(number))[[number[lang] for lang in names]]
        held = [n for _, n, _ in spans]
        plain = np.concatenate(parts)
        hashes = mix(plain ^ np.repeat(of_span, held))
        single = gram_hashes(hashes, 1)
        word = self.known.has(single) & (plain != _BREAK_HASH)
        good = self.good.has(single) & word
        ends = np.cumsum(held)
        starts = np.ones(len(plain), bool)
        for end, (_, n, own) in zip(ends.tolist(), spans):  # what lies ahead belongs to the next stretch
            if own < n - 1:
                starts[end - n + own : end] = False
        base = self.sizes[0] - 1
        shorter = word if base == 1 else self.before.has(gram_hashes(hashes, base))
        whole = word
        for size in range(2, self.sizes[-1] + 1):  # whole: all words of the phrase that starts here are frequent
            rows = len(plain) - size + 1
            if rows <= 0:
                break
            whole = whole[:rows] & word[size - 1 :]
            if size not in self.sizes:
                continue
            first, last = good[:rows], good[size - 1 :]
            fine = whole & starts[:rows] & (first | last)
            fine &= (~first | shorter[:rows]) & (~last | shorter[size - base : size - base + rows])
            at = np.flatnonzero(fine)
            _, place, times = np.unique(gram_hashes(hashes, size)[at], return_index=True, return_counts=True)
            at = at[place]
            out[0].extend(names[i] for i in np.searchsorted(ends, at, "right").tolist())
            out[1].extend(b" ".join(tokens[i : i + size]) for i in at.tolist())
            out[2].extend(times.tolist())
        return out


def _steps(longest: int) -> list[tuple[int, ...]]:
    """Sizes counted in one pass: 2, 3, then two at a time, as few phrases have more words."""
    steps = [(size,) for size in (2, 3) if size <= longest]
    return steps + [tuple(range(size, min(size + 1, longest) + 1)) for size in range(4, longest + 1, 2)]


def _wave(docs: DataFrame, words: DataFrame, good: DataFrame, least: int, longest: int, work: Scratch) -> DataFrame:
    """(lang, phrase, a, size) of the phrases grown from good words, single words included."""
    known, promising = filter_of(words, words.count()), filter_of(good, good.count())
    held, before = words.select("lang", "phrase", "a", F.lit(1).alias("size")), known
    for sizes in _steps(longest):
        grown = _in_tokens(docs, sizes[-1] - 1, lambda: Growth(sizes, known, promising, before)).filter(F.col("a") >= least)
        name = f"size-{sizes[0]}"
        if not work.write(grown.withColumn("size", F.size(F.split("phrase", " "))), name):
            break
        found = work.read(name, "lang string, phrase string, a bigint, size int")
        held = held.unionByName(found)
        if sizes[-1] < longest:
            longer = found.filter(F.col("size") == sizes[-1])
            before = filter_of(longer, longer.count())
    return held


def _survivors(held: DataFrame, good: DataFrame, totals: DataFrame, longest: int, work: Scratch) -> DataFrame:
    """Scored phrases that start and end with a good word and lie in no longer one that is as frequent."""
    words = F.split("phrase", " ")
    ends = held.filter("size > 1").select("lang", "phrase", "size", "a", words.alias("words"))
    good = good.select("lang", F.col("phrase").alias("word"))
    for end in ("words[0]", "words[size - 1]"):
        ends = ends.withColumn("word", F.expr(end)).join(good, ["lang", "word"], "left_semi")
    # A longer phrase that is as frequent holds one longer by a word that is, too.
    inner = F.explode(F.array(F.slice("words", 1, F.col("size") - 1), F.slice("words", 2, F.col("size") - 1))).alias("inner")
    longer = held.filter("size > 2").withColumn("words", words).select("lang", inner, "a")
    longer = longer.select("lang", F.array_join("inner", " ").alias("phrase"), "a")
    alive = ends.select("lang", "phrase", "size", "a", "words").join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = work.cut(
        alive.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
            "lang",
            "phrase",
            "a",
            "k",
            F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
            F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("right"),
        ),
        "cuts",
    )
    part = lambda name, count: held.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    told = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Decimals of 38 digits hold the products, div gives whole numbers.
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    told = told.select("lang", "phrase", "a", "l", "r", "n", "k", *[c.alias(f"_{name}") for name, c in wide.items()])
    told = told.withColumn("score", F.expr("(1000 * _a * _n) div (_l * _r)"))
    best = told.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    return work.cut(best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score"), "scored")


def _first_places(scored: DataFrame, best: int) -> DataFrame:
    # At most ``best`` rows of a language leave a partition.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= best)


def _rare(words: DataFrame, totals: DataFrame, share: int) -> DataFrame:
    """(lang, cutoff): up to this count, words make up 1/``share`` of the language, the rarest at least; in steps of powers of two."""
    step = F.floor(F.log2("a")).cast("int").alias("step")
    steps = words.groupBy("lang", step).agg(F.sum("a").alias("held"))
    upto = Window.partitionBy("lang").orderBy("step")
    steps = steps.join(totals, "lang").withColumns({"upto": F.sum("held").over(upto), "place": F.row_number().over(upto)})
    few = (F.col("place") == 1) | (share * F.col("upto") <= F.col("n"))
    return steps.filter(few).groupBy("lang").agg((F.pow(F.lit(2.0), F.max("step") + 1) - 1).cast("bigint").alias("cutoff"))


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    best: int = BEST,
    first_share: int = FIRST_SHARE,
) -> DataFrame:
    """The first ``best`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to ``longest`` words of one piece and occurs ``a`` times, ``least`` at least. Its score is the
    lowest of its cuts in two, floor(1000 a n / (l r)), exact for up to 10**18 words; ``l`` and ``r`` belong to that cut, the
    first of several. A phrase inside a longer one that occurs as often is left out. In order of score, then a,
    then phrase (by bytes). A null language is ``und``, null and empty texts have no words, rows that repeat
    count again; other columns are ignored. Texts are read whole, a very long one in stretches. No rows give no rows.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "collocations")
    bodies = docs.select(
        F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    )
    counted = work.cut(_in_tokens(bodies, 0, Words), "words")
    totals = work.cut(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    words = work.cut(counted.filter(F.col("a") >= least), "frequent")

    cutoffs = work.cut(_rare(words, totals, first_share), "cutoffs")
    done, wave = None, 0
    while True:
        wave += 1
        stage = Scratch(spark, f"collocations-{wave}")
        own = words.join(cutoffs, "lang")
        open_words, good = stage.cut(own.drop("cutoff"), "open"), stage.cut(own.filter(F.col("a") <= F.col("cutoff")).drop("cutoff"), "good")
        texts = bodies if done is None else bodies.join(cutoffs.select("lang"), "lang", "left_semi")
        held = _wave(texts, open_words, good, least, longest, stage)
        placed = stage.cut(_first_places(_survivors(held, good, totals, longest, stage), best), "placed")

        last = placed.filter(F.col("rank") == best).select("lang", F.col("score").alias("last"))
        left = own.filter(F.col("a") > F.col("cutoff")).groupBy("lang").agg(F.min("a").alias("next"))
        state = left.join(totals, "lang").join(last, "lang", "left")
        promise = F.expr("(1000 * cast(n as decimal(18,0))) div cast(next as decimal(18,0))")
        state = state.filter(F.col("last").isNull() | (promise >= F.col("last")))
        # With all places taken, what can still reach the last one; else everything.
        enough = F.expr("CASE WHEN last > 0 THEN (1000 * cast(n as decimal(18,0))) div cast(last as decimal(18,0)) END")
        open_ = state.select("lang", F.coalesce(enough, F.lit((1 << 63) - 1)).cast("bigint").alias("cutoff"))
        rows = stage.write(open_, "open-languages")
        cutoffs = stage.read("open-languages", "lang string, cutoff bigint")
        settled = placed.join(cutoffs, "lang", "left_anti") if rows else placed
        done = settled if done is None else done.unionByName(settled)
        if not rows:
            return done.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
