import io
import math
import struct

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from lakeimpact.llm import topk, warc


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 12), st.sampled_from([2, 300, 10**7]))
def test_bounds_lose_nobody(seed, m, d, size):
    draw = np.random.default_rng(seed)
    x, q = draw.integers(-size, size + 1, (m, d)), draw.integers(-size, size + 1, (4, d))
    same = draw.random((4, m)) < 0.1
    for i, (left, scores) in enumerate(topk.nra(q, x, same, 5)):
        exact = x @ q[i]
        assert (scores == exact[left]).all()
        rest = np.sort(exact[~same[i]])[::-1][:5]
        assert (np.sort(scores[~same[i][left]])[::-1][: len(rest)] == rest).all()
        if len(rest):  # every tie of the last place is there
            assert set(np.flatnonzero((exact >= rest[-1]) & ~same[i])) <= set(left)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.normal(size=6).round(1)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)] + [(50, rows[50][1])]
    rows += [(450, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [math.nan] * 6), (600, [math.inf] * 6), (None, [1.0] * 6), (650, [1.0, 2.0]), (651, [3.0, 4.0]), (700, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    good = {i: tuple(math.floor(256 * x) for x in v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q, v in good.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good.items() if c != q and len(w) == len(v))
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_components_beyond_exact_scores_fail(spark):
    for x in (1e300, 2.0**30, -(2.0**40)):
        df = spark.createDataFrame([(0, [x] * 4), (1, [1.0] * 4)], "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="is not below"):
            topk.top_k(df).collect()
    most = math.floor(math.sqrt(2**53 / 4)) // 256
    rows = [(0, [float(most)] * 4), (1, [float(most)] * 4), (2, [float(-most)] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 4 * (256 * most) ** 2), (2, -4 * (256 * most) ** 2)]


def test_other_columns_of_any_name(spark):
    names = ["v", "dims", "cell", "at", "qb", "cb", "rank", "query", "score", "query_id"]
    rows = [(i, [float(i % 7), 1.0], *names) for i in range(120)]
    plain = spark.createDataFrame([r[:2] for r in rows], "vec_id bigint, embedding array<double>")
    other = spark.createDataFrame(rows, ["vec_id", "embedding", *names])
    assert sorted(topk.top_k(other).collect()) == sorted(topk.top_k(plain).collect())


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


PAGES = [
    (1, "http://a/x", "<p>é</p>" * 50), (2, "http://b/", "<p>é</p>" * 50), (3, None, None), (4, "http://c/\r\nX: y", ""),
    (5, "u", "long " * 300_000), (6, "u", "<i>alone</i>"), (2, "http://b/", "<p>é</p>" * 50), (None, "n", "<p>é</p>" * 50), (1, "z", "<p>é</p>" * 50),
]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, record_type string")
    got = warc.archive_and_read(df, least=least).collect()
    expected = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        again = len(body) >= least and first is not None and first != i
        expected.append((i, len(body), warc.payload_digest(body), "revisit" if again else "response", first if again else None, None if again else body))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert warc.archive_and_read(df.limit(0)).collect() == []


def archive(records, dictionary=None, packed=False):
    out = io.BytesIO()
    if dictionary is not None:
        body = dictionary.as_bytes()
        body = zstandard.ZstdCompressor().compress(body) if packed else body
        out.write(struct.pack("<II", warc.DICTIONARY_FRAME, len(body)) + body)
    coder = zstandard.ZstdCompressor(dict_data=dictionary)
    for r in records:
        out.write(coder.compress(r))
        out.write(struct.pack("<II", 0x184D2A51, 3) + b"pad")  # other skippable frames are passed over
    return out.getvalue()


@pytest.mark.parametrize("packed", [False, True])
def test_the_dictionary_is_loaded(packed):
    records = [warc.record(i, f"http://x/{i}", f"<html>page number {i} of many</html>".encode() * 9, None) for i in range(300)]
    learned = warc._dictionary(records)
    assert learned is not None
    raw = archive(records, learned, packed)
    assert [r["page_id"] for r in warc.read_archive(io.BytesIO(raw))] == list(range(300))
    with pytest.raises(zstandard.ZstdError):  # and needed
        list(warc.read_archive(io.BytesIO(raw[raw.index(struct.pack("<I", warc.FRAME_MAGIC), 16 if packed else 8) :] if not packed else archive(records, learned)[8 + len(learned.as_bytes()) :])))


def test_damage_is_found():
    good = warc.record(1, "u", b"hello", None)
    assert warc.parse(good)["payload"] == b"hello"
    for bad in (
        good[:-1], good + b"x", good.replace(b"hello", b"hullo"), good.replace(b"WARC/1.1", b"WORC/1.1"),
        good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Record-ID", b"X-Record-ID"),
        good.replace(b"Content-Length: 5", b"Content-Length: 6"),
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)
    raw = archive([good])
    for cut in (raw[:20], raw[:-2], b"junk" + raw):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(cut)))
