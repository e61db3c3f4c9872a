"""The pipeline against what its operators' contracts say, on small tables."""

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lakeimpact.llm import bpe, langid, mixing
from lakeimpact.session import scratch_root

from .test_copies import normal, shingles


def test_stages_against_brute_force(spark, documents, tmp_path):
    en, de = "the cat and the dog were here with the others of that house", "der Hund und die Katze sind nicht mit dem anderen in dem Haus"
    rows = [(i, f"{(en, de)[i % 2]} {' '.join(f'{c}{i}' for c in 'abcdefg')}", ("en", "de")[i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[4][1], "en", "s1"), (101, None, None, None), (102, "1 2 3", "en", "s1"), (103, " ".join(f"z{i}" for i in range(90)) + " the", "en", "s0")]
    rows += [(104, rows[-1][1] + " end", "en", "s2"), (None, "the house and the cat", "en", None)]
    docs = documents(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))

    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns
    model = langid.train(docs.filter(~langid.held_out()))
    clear = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and not r.ambiguous}
    left = [r for r in rows if r[0] in clear]
    assert 101 not in clear and 102 not in clear and len(left) >= 60
    seen, unique = set(), []
    for r in sorted((r for r in left if r[0] is not None), key=lambda r: r[0]):
        if normal(r[1]) not in seen:
            seen.add(normal(r[1]))
            unique.append(r)
    alone = [r for k, r in enumerate(unique) if not any(
        100 * len(shingles(r[1]) & shingles(b[1])) >= 75 * len(shingles(r[1]) | shingles(b[1])) for b in unique[:k])]
    assert {100, 104}.isdisjoint(r[0] for r in alone)
    alone += [r for r in left if r[0] is None]
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.RANK_FILE), special_tokens={}
    )
    expected = []
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(documents(alone)).collect()}
    for r in alone:
        ids = library.encode_ordinary(r[1])
        expected += [(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * copies[r[0]]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()), key=repr) == sorted(expected, key=repr)


def test_no_documents(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


ODD = ["_key", "_copy", "_copies", "a.b", "x`y", "kept", "copies", "source_key", "_c0", "_text", "n", "_label", "ambiguous"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_any_column_names(spark, stage):
    """Extra columns of any name come out of each stage as they went in."""
    rows = [(i, f"the cat and the dog were here {i} {'z' * (i % 9)}", "en", f"s{i % 2}", 5) for i in range(30)]
    rows += [(i, f"der Hund und die Katze sind da {i}", "de", None, 6) for i in range(30, 60)] + [(99, rows[7][1], "en", "s1", 7)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *ODD]
    docs = spark.createDataFrame([(*r, *[f"{c}-{r[0]}" for c in ODD]) for r in rows], names)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    if stage == "bpe":
        assert out.count() == len(rows)
        return
    assert out.columns == names
    given = {tuple(r) for r in docs.collect()}
    kept = [tuple(r) for r in out.collect()]
    assert kept and set(kept) <= given
    if stage == "exact_dedup":
        assert given - set(kept) == {tuple(r) for r in docs.filter("doc_id = 99").collect()}


def test_only_the_result_stays_in_the_shared_folder(spark, documents, tmp_path):
    rows = [(i, f"the cat and the dog {i} were {i % 5} here", "en", f"s{i % 2}") for i in range(40)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    (left,) = set(root.iterdir()) - before
    assert [p.name for p in left.iterdir()] == ["bpe"] and out.count() > 0


def test_the_last_stage_remembers_fewer_matches(spark, documents, monkeypatch):
    """Its workers share the executor with what earlier stages took."""
    given = {}
    monkeypatch.setattr(bpe, "encode_decode", lambda *args, **named: given.update(named))
    corpus_pipeline.tokens(spark, documents([(1, "a", "en", "s")]), "")
    assert given["remembered"] <= bpe.Bpe.REMEMBERED // 2
