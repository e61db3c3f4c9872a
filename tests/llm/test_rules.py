"""Quality rules against a brute-force version."""

import math
import random
import re
from collections import Counter

import regex

from lakeimpact.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def classes(text):
    taken = []
    for pattern in (r"\p{Ll}", r"\p{Lu}", r"\p{L}", r"\p{N}", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"(?s)."):
        rest = regex.sub(pattern, "", text)
        taken.append(len(text) - len(rest))
        text = rest
    return taken


def distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x) / 2
    return math.sqrt(max(0, half(p, q) + half(q, p)))


def shares(ns):
    return [n / sum(ns) for n in ns]


def brute(rows):
    tokens = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    found = []
    for i, text, lang, *_ in rows:
        own = [t for _, t, other, *_ in rows if (other or "und") == (lang or "und")]
        held = Counter(w for t in own for w in tokens(t))
        base = counts(text)
        mine, known = Counter(tokens(text)), sum(held.values())
        word = kind = None
        if known >= 1000:
            common = sorted(held, key=lambda w: (-held[w], w))[:32]
            with_rest = lambda c: shares([*(c[w] for w in common), sum(c.values()) - sum(c[w] for w in common)])
            if sum(mine.values()) >= 100:
                word = round(distance(with_rest(mine), with_rest(held)), 6)
            if len(text or "") >= 200:
                every = [sum(c) for c in zip(*(classes(t or "") for t in own))]
                kind = round(distance(shares(classes(text)), shares(every)), 6)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        found.append((i, *base, failed, word, kind, not failed and (word or 0) <= 0.45 and (kind or 0) <= 0.33))
    return sorted(found, key=repr)


def corpus(seed=5):
    draw = random.Random(seed)
    usual = ["the", "of", "and", "Haus", "école", "x1", "in,"]
    prose = lambda n: " ".join(draw.choice(usual) if draw.random() < 0.5 else f"{draw.choice('abcdé')}{draw.randrange(500)}w" for _ in range(n))
    rows = [(i, prose(draw.choice([20, 60, 150, 400])), draw.choice(["en", None]), "a") for i in range(40)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \t\n\x0b", "en", "a"), (None, prose(80), "en", "a")]
    rows += [(103, "one two three " * 40, "en", "a"), (104, "a b a b a b c d e f " + prose(60), "en", "a")]
    rows += [(105, "same line\nother\n\nsame line\n \nother" + "\nmore words" * 30, "en", "a"), (105, "same line", "zz", "a")]
    rows += [(106, "#$% && | <> **\r\n" * 60, "en", "a"), (107, "日本語 " * 70, "en", "a"), (108, "QQ WW!! " * 90, "en", "a")]
    rows += [(109, rows[0][1], "en", "a"), (109, rows[0][1], "en", "a")]  # rows that repeat
    return rows


def test_counts_and_distances(documents):
    rows = corpus()
    found = rules.judge(documents(rows))
    assert found.columns == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "word_distance", "class_distance", "kept",
    ]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_very_long_text(documents):
    draw = random.Random(1)
    long = " ".join(f"w{draw.randrange(30_000)}" for _ in range(200_000))
    rows = [(1, long, "en", "a"), (2, "x" * 2_000_000, "en", "a"), (3, "y\n" * 100_000, "en", "a")]
    assert sorted((tuple(r) for r in rules.judge(documents(rows)).collect()), key=repr) == brute(rows)


def test_no_rows(documents):
    assert rules.judge(documents(corpus()).limit(0)).collect() == []


def test_no_python_workers(documents):
    plan = rules.judge(documents(corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_junk_goes_and_prose_stays(documents):
    rows = [r for r in corpus(8) if r[1] and len(r[1]) > 600]
    junk = {106, 108}
    kept = {r.doc_id: r.kept for r in rules.judge(documents(rows)).collect()}
    assert not any(kept[i] for i in junk & set(kept))
    assert all(k for i, k in kept.items() if i is not None and i < 40)


def test_windows_are_hashed_over_the_words_themselves(documents):
    """No array of places is made for them, and the last window counts like the first."""
    texts = ["a b c", "a b c a b c", "x a b c y a b c", "a b c x a b", "a a a a", "a b", ""]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    counted = rules._counted(docs, "doc_id", "text", "lang")
    assert [r["n_repeat_words"] for r in counted.orderBy("doc_id").collect()] == [0, 6, 6, 0, 4, 0, 0]
    assert "sequence(" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_are_counted_in_what_the_classes_leave(documents):
    """No pass over the whole text for them, and none lost to a class that stands next to them."""
    texts = ["#a*B$1%.,&-|(<)>é", "x" * 300 + "&&\n\t||", "no sign", "日#本 ½%", "", None]
    counted = rules._counted(documents([(i, t, "en", "s") for i, t in enumerate(texts)]), "doc_id", "text", "lang")
    assert [r["n_symbols"] for r in counted.orderBy("doc_id").collect()] == [8, 4, 0, 2, 0, 0]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert rules.SYMBOLS in plan and not re.search(r"\(_text#\d+, " + re.escape(rules.SYMBOLS), plan)
