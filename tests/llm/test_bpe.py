import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lakeimpact.llm import bpe, common

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.read_ranks(FILE), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={}
    )


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "a  b \n\n c\t\td ",
        "x\x1cy \x1d z\x85w v   u​t﻿",
        "it's we'll I'M they've 'sx",
        "año naïve 東京 12345 ½ ٣٤ 🙂🙂 \r\n\r\n ...!!",
        "a" * 5000,
        "ab" * 3000 + " " * 400 + "é" * 900,
        "<|endoftext|> \x00\x01",
    ],
)
def test_same_ids_as_the_library(coder, library, text):
    ids = coder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t'slé1½,.\x1c\x85　🙂"), max_size=40))
def test_any_mixture_of_classes(coder, library, text):
    assert coder.encode(text) == library.encode_ordinary(text)


def test_merges_of_a_lower_rank_than_their_parts():
    """A rank file in any order: a merge may open a pair that comes before the current rank."""
    ranks = {bytes([b]): 1000 + b for b in range(256)}
    ranks |= {b"abc": 0, b"ab": 5, b"bc": 7, b"abcab": 3, b"ca": 6}
    coder = bpe.Bpe(ranks, r"\S+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("abc") for _ in range(draw.randint(1, 30)))
        assert coder.encode(text) == library.encode_ordinary(text)


def test_forgetting_changes_nothing(coder, library):
    small = bpe.Bpe(coder.ranks, public_tokenizers.PATTERN)
    small.REMEMBERED = 2
    text = "one two three two one four " * 3
    assert small.encode(text) == library.encode_ordinary(text)


def test_the_memory_keeps_what_comes_back(coder, library):
    """Words that are met again and again are merged once, however many others there are."""
    small = bpe.Bpe(coder.ranks, public_tokenizers.PATTERN)
    small.REMEMBERED = 400
    text = " ".join(f"wxq{'abcdefghij'[i % 10]}zk yqv{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}j" for i in range(5000))
    merged, merge = [], small.merge
    small.merge = lambda piece: merged.append(piece) or merge(piece)
    assert small.encode(text) == library.encode_ordinary(text)
    assert len(merged) <= 5000 + 11 and len(small.known) + len(small.former) <= 400


@pytest.mark.parametrize("size", [2, 3, 17, 63, 64, 65, 66, 200])
def test_short_and_long_matches_merge_alike(coder, library, size):
    draw = random.Random(size)
    for letters in ("ab", "etaoinshrdlu", "éßñ東京"):
        text = "".join(draw.choice(letters) for _ in range(size))
        assert coder.encode(text) == library.encode_ordinary(text)


def test_what_a_worker_holds_goes_when_another_function_begins():
    gone = []
    common.hold_between_tasks("one", lambda: gone.append("one"))
    common.give_back_memory("one")
    assert not gone
    common.give_back_memory("other")
    common.give_back_memory()
    assert gone == ["one"]


def test_a_vocabulary_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "few.tiktoken"))


def test_rows(spark, library):
    texts = [(1, "Hola señor"), (2, None), (3, ""), (3, "again"), (3, "again"), (None, "x " * 4000)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id bigint, text string, n_tokens string")
    out = bpe.encode_decode(docs, FILE, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == len(texts)
    expected = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.ids) for r in out), key=repr) == sorted(expected, key=repr)
    for r in out:
        assert hashlib.sha256(bytes(r.decoded)).hexdigest() == r.decoded_sha256
    assert bpe.encode_decode(docs.limit(0), FILE, public_tokenizers.PATTERN).collect() == []
