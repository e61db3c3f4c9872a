import pytest

from lakeimpact.llm import mixing


def test_targets_fill_up_and_stop(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 90}
    rows = [((k is None, k or ""), n) for k, n in sizes.items()]
    df = spark.createDataFrame(rows, "source_key struct<missing: boolean, name: string>, source_size bigint")
    got = {r.source_key.name if not r.source_key.missing else None: r for r in mixing.targets(df).collect()}
    assert {k: r.weight for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    # b, d and the null source stop at three times their size; the rest goes 1 to 3.
    assert got["b"].target == 30 and got["d"].target == 0 and got[None].target == 270
    assert got["a"].target == pytest.approx(1300 / 4) and got["c"].target == pytest.approx(1300 * 3 / 4)
    assert sum(r.target for r in got.values()) == pytest.approx(1600)


def test_taken_words(documents):
    rows = [(i, "w " * (i % 40), "en", "big" if i % 3 else "small") for i in range(600)]
    rows += [(1000, None, "en", None), (1001, "a\x0bb", "en", None), (1001, "a\x0bb", "en", None), (None, "x", "en", "tiny")]
    docs = documents(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for source, found in by.items():
        assert {r.source_size for r in found} == {sum(r.size for r in found)}
        assert abs(sum(r.taken for r in found) - found[0].target) <= 3 * max(r.size for r in found), source
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_one_source_gives_itself(documents):
    got = mixing.mix_sources(documents([(i, "a b c", "en", "s") for i in range(10)])).collect()
    assert {r.copies for r in got} == {1} and got[0].target == 30
