"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeimpact.llm import exact_dedup, near_dup, substring
from lakeimpact.llm.components import components
from lakeimpact.session import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)] + ["é", "日本", "x y"]


def prose(draw, n):
    return [draw.choice(VOCABULARY) for _ in range(n)]


def edge_rows():
    return [(None, "same text here", "en", "a"), (None, None, None, None), (900, None, None, None), (901, "", "en", None),
            (902, " \t\n", "en", None), (903, "same text here", "en", "a"), (903, "same text here", "en", "a")]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(found, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for i, t, *_ in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("fingerprint", ["hash", "colliding"])
def test_exact_copies(documents, fingerprint):
    draw = random.Random(3)
    rows = edge_rows()
    long = " ".join(prose(draw, 4000))
    rows += [(1, long, "en", "a"), (2, long.replace(" ", "\n\t"), "en", "b"), (3, long[:-1] + "q", "en", "a"), (4, "q" + long[1:], "en", "a")]
    rows += [(10 + i, " ".join(prose(draw, draw.choice([1, 3, 200, 700]))), "en", "a") for i in range(20)]
    rows += [(50 + i, rows[-1 - i % 5][1], "en", "b") for i in range(20)]
    # Few fingerprints: nearly all chunks have to be told apart.
    kind = F.xxhash64 if fingerprint == "hash" else (lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    check_exact(exact_dedup.exact_dedup(documents(rows), fingerprint=kind), rows)


def test_no_rows(documents):
    none = documents(edge_rows()).limit(0)
    assert exact_dedup.exact_dedup(none).collect() == []
    assert near_dup.near_duplicates(none).collect() == []
    assert substring.remove_repeats(none).collect() == []


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if len(w) >= 5 else frozenset([tuple(w)])


def test_near_copies_equal_brute_force(documents):
    draw = random.Random(5)
    rows = [r for r in edge_rows() if r[0] != 903] + [(903, "same text here", "en", "a"), (904, "Same TEXT  here", "en", "a")]
    n = 0
    for _ in range(25):
        base = prose(draw, draw.choice([6, 40, 150, 400]))
        for _ in range(draw.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 30))):
                copy[draw.randrange(len(copy))] = draw.choice(VOCABULARY)
            rows.append((n, " ".join(copy), "en", "a"))
            n += 1
    base = prose(draw, 120)  # a dense region: more than a window of copies with several edits each
    for _ in range(160):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice(VOCABULARY)
        rows.append((n, " ".join(copy), "en", "a"))
        n += 1
    check_near(documents, rows)


def check_near(documents, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dup.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id == root(r.doc_id))


def test_texts_like_one_member_of_a_thinned_group(documents, monkeypatch):
    """Few nodes stand for a large group in the second round; the last one has them all."""
    monkeypatch.setattr(near_dup, "CENTRAL", 2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        member = list(base)
        member[5 + i] = f"m{i}"
        rows.append((1000 + i, " ".join(member), "en", "a"))
        if i % 4 == 0:  # 0.75 or more of the union with this member only
            like = list(member)
            for at in (0, 1, 2, 116, 117, 118, 119) if i % 8 else (30 if i > 40 else 60, 110):
                like[at] = f"x{i}-{at}"
            rows.append((i, " ".join(like), "en", "a"))
    check_near(documents, rows)


def one_member_rows(members):
    """A large group of copies with one edit each, and texts that are like one member only."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(members):
        member = list(base)
        member[5 + i % 110] = f"m{i}"
        rows.append((10000 + i, " ".join(member), "en", "a"))
        if i % 40 == 0:
            like = list(member)
            for at in (0, 1, 2, 60 if i % 110 > 70 else 90, 117, 118, 119):
                like[at] = f"x{i}-{at}"
            rows.append((i, " ".join(like), "en", "a"))
    return rows


def test_regions_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16, raising=False)
    monkeypatch.setattr(near_dup, "CELL_PAIRS", 20, raising=False)
    check_near(documents, one_member_rows(240))


def dense_cell(members):
    """A cell of copies with four edits each, nearly all of them too far apart to be linked."""
    draw, rows = random.Random(members), []
    base = [f"b{i}" for i in range(110)]
    for i in range(members):
        copy = list(base)
        for at in draw.sample(range(110), 4):
            copy[at] = f"e{i}-{at}"
        found = near_dup.shingle_set(" ".join(copy).encode())
        sig = near_dup.signature(found).byteswap().tobytes()
        rows.append((0, 7, 2, i, len(found), i, 1, sig, found.tobytes()))
    frame = pd.DataFrame(rows, columns=["tree", "region", "side", "node", "n", "component", "cell", "sig", "members"])
    shared = frame["sig"].map(lambda s: s[:6])  # rows of one region share the first values of its tree
    return frame[shared == shared.mode()[0]].reset_index(drop=True)


def test_a_cell_gives_fewer_links_than_nodes():
    sizes = []
    for members in (400, 800):
        cell = dense_cell(members)
        some = near_dup._with_partner(cell.drop(columns="members"))
        assert 20 < len(some) <= len(cell)
        links = near_dup._joining_links(cell[cell["node"].isin(some["node"])], 75)
        sets = {r.node: set(np.frombuffer(r.members, np.uint64)) for r in cell.itertuples()}
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in zip(links["a"], links["b"]))
        # They join what all pairs join, and no two of them join the same.
        group = {n: n for n in sets}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in zip(links["a"], links["b"]):
            assert root(a) != root(b)
            group[root(a)] = root(b)
        nodes = sorted(sets)
        for i, a in enumerate(nodes):
            for b in nodes[:i]:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    assert root(a) == root(b)
        sizes.append(len(some) + len(links))
        assert len(links) < len(some)
    assert sizes[1] <= 2.5 * sizes[0]


def test_very_long_near_copies(documents):
    draw = random.Random(6)
    base = [f"w{draw.randrange(50_000)}" for _ in range(150_000)]
    rows = []
    for i, edits in enumerate([0, 3000, 3000, 20_000]):
        copy = list(base)
        for at in draw.sample(range(len(copy)), edits):
            copy[at] = f"e{i}"
        rows.append((i, " ".join(copy), "en", "a"))
    check_near(documents, rows + [(9, "short", "en", "a")])


def with_signatures(spark, monkeypatch, trees):
    """Signatures are taken from (doc_id: the values of each tree) instead of the texts."""
    real = near_dup._sketches
    given = [(i, np.tile(np.array(v, ">u2"), near_dup.TREES).tobytes()) for i, v in trees.items()]
    given = spark.createDataFrame(given, "doc_id bigint, sig binary")
    monkeypatch.setattr(near_dup, "_sketches", lambda *a: real(*a).drop("sig").join(given, "doc_id"))


def like_pair(x, y):
    """Two texts that overlap by more than 0.75."""
    words = [f"c{i}" for i in range(60)]
    return [(x, " ".join(words), "en", "a"), (y, " ".join(words[:-2] + ["other", "end"]), "en", "a")]


def test_texts_beyond_the_window(spark, documents, monkeypatch):
    """More rivals than the window holds stand between two texts in every tree."""
    rows, trees = like_pair(1, 2), {1: [7, 7, 7, 0, 5, 5, 5, 5], 2: [7, 7, 7, 60000, 5, 5, 5, 5]}
    for i in range(200):  # in twos that have each other as candidates, so none is left out later
        rows.append((100 + i, " ".join(f"r{i}-{j}" for j in range(60)), "en", "a"))
        trees[100 + i] = [7, 7, 7, 100 + i // 2, *[1000 + i // 2] * 4]
    for i in (1, 2):
        rows.append((10 + i, " ".join(f"n{i}-{j}" for j in range(60)), "en", "a"))
        trees[10 + i] = [*trees[i][:4], 5, 5, 9, 9]
    with_signatures(spark, monkeypatch, trees)
    check_near(documents, rows)


def test_texts_without_a_candidate_in_the_first_round(spark, documents, monkeypatch):
    rows, trees = like_pair(1, 2), {1: [7, 7, 7, 0, 5, 5, 5, 5], 2: [7, 7, 7, 60000, 5, 5, 5, 5]}
    rows += [(100 + i, " ".join(f"r{i}-{j}" for j in range(60)), "en", "a") for i in range(80)]
    trees |= {100 + i: [7, 7, 7, 100 + i, *[1000 + i] * 4] for i in range(80)}
    with_signatures(spark, monkeypatch, trees)
    check_near(documents, rows)


def test_low_estimates_behind_rivals_are_confirmed(spark, documents, monkeypatch):
    """Three rivals of either end have a higher estimate and fail on the full sets."""
    rows, trees = like_pair(1, 2), {}
    free = [p for p in range(near_dup.VALUES) if p % near_dup.DEPTH >= near_dup.MINIMUM]  # all else is common
    one, two = np.arange(128), np.arange(128)
    two[free[32:]] += 1000  # 80 of 128 are alike: 0.625
    for x, own in ((1, one), (2, two)):
        trees[x] = own
        for i in range(3):  # 84 are alike, where the ends differ
            rows.append((x * 10 + i, " ".join(f"v{x}-{i}-{j}" for j in range(60)), "en", "a"))
            kept = free[32 + 4 * i : 68 + 4 * i]
            trees[x * 10 + i] = own.copy()
            trees[x * 10 + i][[p for p in free if p not in kept]] += 2000 + 100 * (10 * x + i)
    real = near_dup._sketches
    given = spark.createDataFrame([(i, v.astype(">u2").tobytes()) for i, v in trees.items()], "doc_id bigint, sig binary")
    monkeypatch.setattr(near_dup, "_sketches", lambda *a: real(*a).drop("sig").join(given, "doc_id"))
    check_near(documents, rows)


def test_components_of_chains_and_stars(spark, rows):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 299), (299, 300)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict(rows(components(df, Scratch(spark, "cc"), "t")))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}


def removed(rows, least=13):
    first = {}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - least + 1 if i is not None else 0):
            g = tuple(w[k : k + least])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for k in range(len(w) - least + 1 if i is not None else 0):
            if first[tuple(w[k : k + least])] < i:
                gone.update(range(k, k + least))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [substring.BLOCK_BYTES, 300])
def test_repeated_passages(documents, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    draw = random.Random(9)
    passages = [prose(draw, n) for n in (12, 13, 14, 30, 60)]
    rows = edge_rows() + [(i, " ".join(["la"] * n), "fr", None) for i, n in ((700, 12), (701, 40), (702, 13))]
    for i in range(60):
        words = prose(draw, draw.choice([0, 5, 13, 40]))
        for _ in range(draw.randint(0, 3)):  # next to each other at times, so factors touch
            at = draw.randint(0, len(words))
            words[at:at] = draw.choice(passages)
        rows.append((draw.randrange(500), " ".join(words), "en", "a"))
    rows.append((3, rows[-1][1], "en", "a"))
    order = sorted(rows, key=lambda r: -(r[0] or 0))
    got = substring.remove_repeats(documents(order), keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=repr) == removed(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
