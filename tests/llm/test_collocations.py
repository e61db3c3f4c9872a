"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lakeimpact.llm import collocations as co
from lakeimpact.session import Scratch


def pieces(text):
    plain = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain)]


def brute(rows, least, longest, best):
    found = []
    for lang in {r[2] or "und" for r in rows}:
        count = Counter()
        for _, text, other, *_ in rows:
            if (other or "und") == lang:
                for w in pieces(text):
                    count.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in count.items() if len(p) == 1)
        kept = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        inner = {(p[i : i + k], c) for p, c in kept.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        scored = []
        for p, a in kept.items():
            if (p, a) not in inner:
                score, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], n))
        for rank, (score, _, p, a, left, right, n) in enumerate(sorted(scored)[:best], 1):
            found.append((lang, rank, p.decode(), a, left, right, n, -score))
    return sorted(found, key=repr)


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "x|y", " ", "A", "a"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    set_phrases = [" ".join(draw.choices(vocabulary, k=draw.randint(2, 6))) for _ in range(12)] + ["the the the the the the", "rare1 rare2 rare3"]

    def prose(k):
        return "".join(
            (draw.choice(set_phrases) if draw.random() < 0.3 else draw.choices(vocabulary, weights)[0]) + draw.choice([" ", "  ", "\t", " ", ", ", ".\n", " \x0b"])
            for _ in range(k)
        )

    rows = [(i, prose(draw.choice([3, 40, 120])), draw.choice(["en", "fr", None]), "a") for i in range(n)]
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, " \t\n.,", "en", "a"), (None, prose(50), "und", "a"), (903, "one word", "zz", "a")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("least, best, first_share", [(4, 2000, 8), (4, 7, 40), (3, 25, 3), (6, 1, 1000)])
def test_collocations(documents, least, best, first_share):
    rows = corpus(least * 100 + best)
    found = co.mine(documents(rows), least=least, best=best, first_share=first_share)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, least, 5, best)


def test_shorter_phrases_and_no_rows(documents):
    rows = corpus(9, 20)
    assert sorted((tuple(r) for r in co.mine(documents(rows), least=3, longest=3).collect()), key=repr) == brute(rows, 3, 3, 2000)
    assert sorted((tuple(r) for r in co.mine(documents(rows), least=3, longest=7).collect()), key=repr) == brute(rows, 3, 7, 2000)
    assert co.mine(documents(rows).limit(0)).collect() == []
    assert co.mine(documents([(1, "all words differ here", "en", "a")])).collect() == []


def test_ties_at_the_last_place(documents):
    text = "; ".join(f"p{i} q{i}" for i in range(40)) + ". "
    rows = [(1, text * 3, "en", "a")]
    assert sorted((tuple(r) for r in co.mine(documents(rows), least=3, best=10).collect()), key=repr) == brute(rows, 3, 5, 10)


def test_large_products(documents):
    """Scores of counts whose products pass 64 bits."""
    spark = documents([]).sparkSession
    a, n, left, right = 3 * 10**12, 7 * 10**13, 4 * 10**12, 5 * 10**12
    held = [("en", "x y", a, 2), ("en", "x", left, 1), ("en", "y", right, 1)]
    held = spark.createDataFrame(held, "lang string, phrase string, a bigint, size int")
    good = held.filter("size = 1")
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    found = co._survivors(held, good, totals, 5, Scratch(spark, "test")).collect()
    assert [r["score"] for r in found] == [1000 * a * n // (left * right)]


def test_growth_leaves_out_what_promises_too_little(documents):
    """Phrases of frequent words only are not counted where the rare ones fill the places."""
    spark = documents([]).sparkSession
    rows = [(1, "the of the of and the " * 200 + ". " + ". ".join(f"p{i} q{i}" for i in range(30)) * 1, "en", "a")] * 4
    bodies = documents(rows).selectExpr("lang", "cast(text as binary) as body")
    counted = co._in_tokens(bodies, 0, co.Words)
    words = counted.filter("a >= 4").cache()
    good = words.filter("a <= 4").cache()
    held = co._wave(bodies, words, good, 4, 5, Scratch(spark, "test"))
    phrases = {r["phrase"] for r in held.filter("size > 1").collect()}
    assert phrases == {f"p{i} q{i}" for i in range(30)}
    found = co.mine(documents(rows), least=4, best=20)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 4, 5, 20)


def test_stretches_of_a_long_text(monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["a", "Bc", "d" * 300, "é"]) + draw.choice([" ", "   ", "\t", ", ", "\n"]) for _ in range(3000)).encode()
    whole, own = next(co.token_lists(text, 4))
    assert own == len(whole) - 1 and whole[-1] == co.BREAK
    for piece in (1, 7, 100, 5000):
        monkeypatch.setattr(co, "PIECE", piece)
        at = 0
        for found, own in co.token_lists(text, 4):
            assert found[:-1] == whole[at : at + own + 4][: len(found) - 1] and len(found) - 1 >= min(own + 4, len(whole) - 1 - at)
            at += own
        assert at == len(whole) - 1


def test_filters_know_all_of_their_set(documents):
    spark = documents([]).sparkSession
    phrases = [(lang, f"w{i} v{i % 7}") for i in range(5000) for lang in ("en", "ü")]
    kept = co.filter_of(spark.createDataFrame(phrases, "lang string, phrase string"), len(phrases))
    assert kept.has(co.phrase_hashes(*map(list, zip(*phrases)))).all()
    others = co.phrase_hashes(["en"] * 5000, [f"x{i} y{i}" for i in range(5000)])
    assert kept.has(others).mean() < 0.1
    assert not co.filter_of(spark.createDataFrame([], "lang string, phrase string"), 0).has(others).any()


def test_steps_of_growth():
    assert co._steps(2) == [(2,)] and co._steps(3) == [(2,), (3,)] and co._steps(4) == [(2,), (3,), (4,)]
    assert co._steps(5) == [(2,), (3,), (4, 5)] and co._steps(8) == [(2,), (3,), (4, 5), (6, 7), (8,)]


def test_tokens_have_the_hashes_of_phrases():
    everything, nothing = co.Filter(16, np.full(1 << 13, 255, np.uint8)), co.Filter(16, np.zeros(1 << 13, np.uint8))
    grown = co.Growth((2,), everything, everything, everything)
    for lang in ("ü", "en", "ü"):
        grown.add(lang, [b"w3", b"v3", co.BREAK, b"w3", b"v3", b"x", co.BREAK], 5)
    found = sorted(zip(*grown.rows()))
    assert found == [("en", b"v3 x", 1), ("en", b"w3 v3", 2), ("ü", b"v3 x", 2), ("ü", b"w3 v3", 4)]
    assert grown.rows() == ([], [], [])
    assert not co.Growth((2,), nothing, everything, everything).rows()[0]
    few = co.Growth((3,), everything, nothing, everything)
    few.add("en", [b"a", b"b", b"c", co.BREAK], 3)
    assert few.rows() == ([], [], [])
    assert len(set(co.phrase_hashes(["en", "ü"], ["w3 v3", "w3 v3"]))) == 2
