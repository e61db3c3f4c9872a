"""Classifiers: held-out accuracy on given tables, and the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeimpact.llm import grams, langid, quality, secrets
from lakeimpact.llm.common import crc_mod, table
from lakeimpact.session import Scratch

SF = "/root/testdata/sf0.01"


def test_codewords_stand_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        assert distance.min() >= (1 if n == 2 else 2 if n < 5 else 3)
        assert (abs(code.sum(axis=0)) < n).all()


def test_counts_do_not_depend_on_pieces():
    body = bytes(np.random.default_rng(1).integers(0, 256, (1 << 20) + 500, dtype=np.uint8))
    found = grams.counts(body, (2, 3), 12)
    assert found.sum() == 2 * len(body) - 3
    assert grams.counts(b"", (2, 3), 12).sum() == 0


def plain_counts(body, orders, bits):
    """N-grams one by one."""
    found = [0] * (1 << bits)
    for n in orders:
        for i in range(len(body) - n + 1):
            v = int.from_bytes(body[i : i + n], "little") + n * 0x3C6EF35F
            found[(v * 2654435761 & 0xFFFFFFFF) >> (32 - bits)] += 1
    return found


def some_texts(spark, n=25):
    rows = table(spark, SF, "documents").orderBy("doc_id").limit(400).collect()
    return [r for r in rows if r.text and len(r.text) < 3000][:n]


def test_languages_equal_brute_force(spark):
    """Features, losses and the nearest codeword of the fitted model, each by loops."""
    docs = table(spark, SF, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    texts = some_texts(spark)
    chosen = docs.filter(F.col("doc_id").isin([r.doc_id for r in texts]))
    got = {r.doc_id: r for r in langid.identify(chosen, model).collect()}
    for r in texts:
        letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in r.text)
        found = plain_counts(b" " + b" ".join(letters.encode().split()) + b" ", langid.ORDERS, langid.BITS)
        x = [(c / sum(found)) ** 0.5 for c in found]
        said = [sum(v * w for v, w in zip(x, column) if v) + b for column, b in zip(model.weights.T.tolist(), model.bias.tolist())]
        losses = [sum(math.log1p(math.exp(-s * bit)) for s, bit in zip(said, word)) for word in model.code.tolist()]
        share = math.exp(-min(losses)) / sum(math.exp(-loss) for loss in losses)
        best = model.languages[losses.index(min(losses))]
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(share, abs=2e-3)
        assert got[r.doc_id].ambiguous == (got[r.doc_id].score < 0.5)


def test_quality_equals_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs.filter(~quality.held_out()), labels.filter(~quality.held_out()))
    texts = some_texts(spark)
    chosen = docs.filter(F.col("doc_id").isin([r.doc_id for r in texts]))
    got = {r.doc_id: r for r in quality.judge(chosen, model).collect()}
    for r in texts:
        body = r.text.encode()
        found = plain_counts(body.translate(quality._LOWER), quality.ORDERS, quality.BITS)
        words, lines = body.split(), body.split(b"\n")
        x = [(c / sum(found)) ** 0.5 for c in found]
        x += [(sum(b in chars for b in body) / len(body)) ** 0.5 for chars in quality._KINDS.values()]
        x += [len(set(words)) / len(words), len(set(lines)) / len(lines), min(1, sum(map(len, words)) / len(words) / 20), math.log1p(len(words)) / 12, 1]
        raw = sum(v * w for v, w in zip(x, model.weights.tolist()))
        score = 1 / (1 + math.exp(-(8 * (raw - model.threshold) / model.spread + math.log(0.3 / 0.7))))
        assert got[r.doc_id].score == pytest.approx(score, abs=2e-3)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_quality_at_the_edges(spark, documents):
    """No rows, rows that repeat, a very long text, an id with both labels."""
    rows = [(i, ("good plain words here " if i % 2 else "BAD!! BAD!! ") * 5, "en", "a") for i in range(40)]
    rows += [(1, rows[1][1], "en", "a"), (50, "good plain words " * 120_000, "en", "a"), (None, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1)], "doc_id bigint, quality int")
    docs = documents(rows)
    model = quality.train(docs, labels)
    got = quality.judge(docs, model).collect()
    assert len(got) == len(rows)
    said = {r.doc_id: r.predicted for r in got}
    assert all(0 <= r.score <= 1 for r in got) and all(said[i] == i % 2 for i in range(40) if i != 3)
    assert len({(r.score, r.predicted) for r in got if r.doc_id == 1}) == 1
    none = docs.limit(0)
    assert quality.judge(none, quality.train(none, labels)).collect() == []
    assert quality.judge(none, model).collect() == []


def test_quality_learns_from_every_labelled_row(spark, documents):
    """The threshold is that of the scores of all rows, however many there are of a label."""
    rows = [(i, f"w{i * 7919 % 1000} {'fine words of a text' if i % 3 else 'SHOUT !! 99'} v{i * 104729 % 977}", "en", "a") for i in range(13_000)]
    docs = documents(rows)
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 > 0 or doc_id % 21 = 0) AS quality")
    model = quality.train(docs, labels)
    scores = np.sort([model.raw(quality.features(t.encode()).astype(np.float16).astype(np.float32)) for _, t, _, _ in rows])
    bad = sum(not (i % 3 or i % 21 == 0) for i in range(13_000))
    assert bad == 3714
    assert model.threshold == pytest.approx((scores[bad - 1] + scores[bad]) / 2, abs=1e-5)


def test_vectors_and_blocks_hold_every_row(spark, documents, monkeypatch):
    """Copies and ids with two labels count; each block has rows of the rare label."""
    monkeypatch.setattr(grams, "BLOCK", 100)
    monkeypatch.setattr(grams, "LEAST", 3)
    docs = documents([(i, f"text {i}", None, None) for i in range(1000)] + [(5, "text 5", None, None)] * 500 + [(None, "x", None, None)])
    known = spark.createDataFrame([(i, int(i >= 4)) for i in range(900)] + [(7, 0), (5000, 1)], "doc_id bigint, _label int")
    work = Scratch(spark, "test")
    vectors = grams.labelled_vectors(docs, known, "_label", "doc_id", "text", quality.features, work)
    held = {r["label"]: r["count"] for r in vectors.groupBy("label").count().collect()}
    assert held == {0: 5, 1: 1396}
    # 14 blocks: the five rows of label 0 are in nine each.
    assert grams.fit_in_blocks(vectors, held, lambda x, y: np.array([len(y), (y == 1).sum(), (y == 0).sum(), 1]))[:2] * 14 == pytest.approx([1396 + 45, 1396])
    assert grams.fit_in_blocks(vectors, held, lambda x, y: np.array([min((y == 1).sum(), 50)]))[0] == 50
    work.release()


def test_odds_are_those_of_other_folds(spark):
    """A word that only one document has says nothing about that document's own label."""
    rows = [(i, "p", False, "c", "x", "word" if i < 40 else f"own{i}", "y", i % 2) for i in range(80)] + [(900, "p", True, "c", "x", "own50", "y", None)]
    found = spark.createDataFrame(rows, "doc_id bigint, path string, held_out boolean, candidate string, before2 string, before string, after string, label int")
    learned = found.filter("not held_out and label is not null")
    odds = {r.doc_id: r.before_odds for r in secrets._with_odds(found, learned, Scratch(spark, "test")).collect()}
    assert all(odds[i] == 0 for i in range(40, 80))
    assert odds[900] == pytest.approx(math.log(0.5 / 1.5))  # not learned from: all findings of its word count
    folds = {r.doc_id: r.fold for r in found.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(secrets.FOLDS)).alias("fold")).collect()}
    for i in range(40):
        others = [j % 2 for j in range(40) if folds[j] != folds[i]]
        assert odds[i] == pytest.approx(math.log((sum(others) + 0.5) / (len(others) - sum(others) + 0.5)))


def test_languages(spark):
    docs = table(spark, SF, "documents")
    out = langid.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n, held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.max(crc_mod("doc_id", 4))).first()
    assert n > 150 and right >= 0.97 and held == 2


def test_languages_at_the_edges(documents):
    rows = [(i, t, g, None) for i, (t, g) in enumerate([("the cat and the dog ", "en"), ("der Hund und die Katze ", "de")] * 20)]
    model = langid.train(documents(rows))
    odd = documents([(1, None, None, None), (1, "", None, None), (2, "12 ... 34", "en", None), (None, "und die Katze", None, None), (3, "the dog " * 90000, None, None)])
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (None, "de"), (3, "en")}
    assert all(0 <= r.score <= 1 for r in langid.identify(odd, model).collect())
    nothing = langid.train(documents(rows).limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []
    single = langid.train(documents(rows).filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(odd.filter("doc_id = 3"), single).collect()} == {"en"}


def test_as_many_labels_as_are_taken(spark):
    """A thousand labels are sampled within the bound on all rows, more are refused."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id, ' of ', id % 1000) AS text", "concat('l', id % 1000) AS lang")
    x, y, held = grams.labelled_sample(docs, "lang", "doc_id", "text", 1000, langid.features)
    assert len(held) == 1000 and len(set(y)) == 1000 and x.shape == (3000, 1 << langid.BITS)
    few = grams.labelled_sample(docs, "lang", "doc_id", "text", 1, langid.features)[1]
    assert 500 < len(few) <= 1000
    model = langid.train(docs, steps=2)
    assert len(model.languages) == 1000
    assert all(r.lang_pred in model.languages for r in langid.identify(docs.limit(5), model).collect())
    more = docs.selectExpr("doc_id", "text", "concat('l', doc_id % 1001) AS lang")
    with pytest.raises(ValueError, match="more than 1000"):
        langid.train(more)


def test_rows_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(grams, "MOST_ROWS", 60)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "concat('l', id % 3) AS lang")
    assert 20 < len(grams.labelled_sample(docs, "lang", "doc_id", "text", 1000, langid.features)[1]) <= 60
    same = spark.range(3000).selectExpr("1 AS doc_id", "'one text' AS text", "'en' AS lang")  # all drawn or none
    assert len(grams.labelled_sample(same, "lang", "doc_id", "text", 1000, langid.features)[1]) <= 60


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = quality.learn_and_judge(docs, labels)
    assert out.count() == docs.count()
    held = out.filter("held_out").join(labels, "doc_id")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95
    low, high, wrong = out.agg(F.min("score"), F.max("score"), F.count_if((F.col("score") >= 0.3) != (F.col("predicted") == 1))).first()
    assert 0 <= low <= high <= 1 and wrong == 0


@pytest.mark.parametrize("label", [0, 1])
def test_quality_of_one_label(spark, documents, label):
    docs = documents([(1, "good words here", None, None), (2, None, None, None), (None, "", None, None)])
    labels = spark.createDataFrame([(1, label), (2, None), (5, 1 - label)], "doc_id bigint, quality int")
    got = quality.judge(docs, quality.train(docs, labels)).collect()
    assert len(got) == 3 and {r.predicted for r in got} == {label}


def test_secrets_in_the_word_of_their_name(documents):
    texts = {
        "see api_key=0123456789abcdef0123 more": "0123456789abcdef0123",
        'see api_key="0123456789abcdef0123" more': "0123456789abcdef0123",
        'the aws_secret_access_key="wJalrXUtnFEMIK7MDENGbPxRfiCY" x': "wJalrXUtnFEMIK7MDENGbPxRfiCY",
        "the AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCY": "wJalrXUtnFEMIK7MDENGbPxRfiCY",
        '{"api_key":"0123456789abcdef0123"}': "0123456789abcdef0123",
        "https://h.org/p?api_key=0123456789abcdef0123&x=1": "0123456789abcdef0123",
        "password=hunter2x8": "hunter2x8",
        'token = "abc123def" here': "abc123def",
        "secret: QUJDREVGR0hJSktMTU5PUDEy== end": "QUJDREVGR0hJSktMTU5PUDEy==",
    }
    found = secrets.candidates(documents([(i, t, "en", "a") for i, t in enumerate(texts)]))
    labelled = found.withColumn("label", secrets.weak_label(F.col("before2"), F.col("before"), F.col("candidate")))
    got = [(r.doc_id, r.candidate) for r in labelled.filter("label = 1").collect()]
    assert sorted(got) == list(enumerate(texts.values()))
    plain = documents([(1, "hunter2x8 is no key, token counts abcdef123", "en", "a")])
    assert secrets.candidates(plain).collect() == []


def test_secrets_learn_from_findings(spark, documents):
    rows = []
    for i in range(120):
        word = "the " * 3
        if i % 3 == 0:
            rows.append((i, f'{word}token = "{i * 7919:040x}" more words', "en", "a/b.py"))
        else:
            rows.append((i, f"{word}see wordsandwordsandwords{i % 5} more words", "en", "c.md"))
    rows += [(None, None, None, None), (500, "", "en", None), (501, 'secret: "aaaabbbbccccdddd1111"', "en", None), (501, 'secret: "aaaabbbbccccdddd1111"', "en", None)]
    docs = documents(rows)
    got = secrets.scan(docs, held_out=crc_mod("doc_id", 5) == 0).collect()
    assert len(got) == 122
    first = [r for r in got if r.doc_id is not None and r.doc_id < 120]
    held = [r for r in first if r.held_out]
    assert held and sum(r.is_secret == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    labelled = spark.createDataFrame([(r.doc_id, r.word_no, r.run_no, 1 - r.label) for r in first], "doc_id bigint, word_no int, run_no int, label int")
    turned = secrets.scan(docs, labelled).filter("doc_id < 120").collect()
    assert sum(r.is_secret == (r.doc_id % 3 != 0) for r in turned) >= 0.95 * len(turned)
    assert secrets.scan(docs.limit(0)).collect() == []
    assert {r.is_secret for r in secrets.scan(docs.filter("doc_id % 3 <> 0 and doc_id < 100")).collect()} == {False}
