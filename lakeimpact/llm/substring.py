"""Substring deduplication against indexed reference blocks.

A stand-in for a relative Lempel-Ziv parse: phrases are looked up, not factored. A parse against every block
would carry block, place and length of each factor, eight bytes and more per phrase where an answer here is one bit.

1. Documents are packed into reference blocks of a few MB. A block is indexed by the hashes of its
   phrases (``least`` consecutive words); a phrase is listed once per block, by its first document.
2. Index entries meet by phrase, in buckets of hash ranges. A block learns, one bit per entry,
   whether an earlier document of any block has the phrase.
3. Each document then becomes spans: runs of words at each of which a phrase starts that occurs in an earlier
   document, with the phrases' own words. Runs that overlap become one span, which may so be made of phrases of several
   earlier documents. Phrases are compared by 64-bit hashes, their words are not compared again.

Texts travel once, for step 3. Index entries travel as packed arrays, eight bytes a phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import gram_hashes, utf8, word_hashes

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20  # text per bucket of the index


def _phrases(body: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase at each word, and the places of each distinct one's first occurrence, ascending."""
    found = gram_hashes(word_hashes(body.split()), least)
    return found, np.sort(np.unique(found, return_index=True)[1])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _index_blocks(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """(bucket, block, kind, ids, texts, counts, body) rows; kind 0 has index entries, kind 1 what the block knows by itself."""
    schema = "bucket int, block bigint, kind int, ids binary, keys binary, counts binary, body binary"

    def packed(block: int, held: list[tuple[int, int, np.ndarray]]):
        held.sort(key=lambda x: x[:2])  # by id; the order of equal ids doesn't matter
        ids = np.array([h[0] for h in held], np.int64)
        keys = np.array([h[1] for h in held], np.uint64)
        counts = np.array([len(h[2]) for h in held], np.uint32)
        hashes = np.concatenate([h[2] for h in held]) if held else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), counts)
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        known = ids[owner[first[place]]] < ids[owner]  # an earlier document of this block has it
        yield (int(block % buckets), block, 1, ids.tobytes(), keys.tobytes(), counts.tobytes(), np.packbits(known).tobytes())
        hashes, owner = hashes[~known], owner[~known]
        at = _bucket(hashes, buckets)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        for b in np.unique(at):
            mine = order[cuts[b] : cuts[b + 1]]
            docs_of, n = np.unique(owner[mine], return_counts=True)  # ascending already
            yield (int(b), block, 0, ids[docs_of].tobytes(), docs_of.astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), hashes[mine].tobytes())

    def batch_of(rows):
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, first = _phrases(body, least)
                if not len(first):
                    continue
                held.append((doc_id, xxhash.xxh3_64_intdigest(body), found[first]))
                size += len(body)
                if size >= BLOCK_BYTES:
                    yield batch_of(list(packed(block, held)))
                    block, held, size = block + 1, [], 0
        if held:
            yield batch_of(list(packed(block, held)))

    chosen = docs.filter("doc_id is not null").select("doc_id", "body")
    return chosen.mapInArrow(run, schema)


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket of the index: which entries have an earlier document elsewhere."""
    own = frame[frame["kind"] == 1].assign(body=lambda f: f["body"])
    rest = frame[frame["kind"] == 0]
    answers = []
    if len(rest):
        counts = [np.frombuffer(c, np.uint32) for c in rest["counts"]]
        hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in rest["body"]])
        ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), c) for i, c in zip(rest["ids"], counts)])
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        starts = np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]])
        first = np.minimum.reduceat(ids[order], starts)
        earlier = np.empty(len(hashes), bool)
        earlier[order] = np.repeat(first, np.diff(np.r_[starts, len(hashes)])) < ids[order]
        at = 0
        for c in counts:
            n = int(c.sum())
            answers.append(np.packbits(earlier[at : at + n]).tobytes())
            at += n
        rest = rest.assign(body=answers, ids=b"")
    return pd.concat([own, rest])[["bucket", "block", "kind", "ids", "keys", "counts", "body"]]


def _per_document(frame: pd.DataFrame) -> pd.DataFrame:
    """All answers of one block as bits per document: what the block knew, then the rest by bucket."""
    own = frame[frame["kind"] == 1].iloc[0]
    ids, keys = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["keys"], np.uint64)
    counts = np.frombuffer(own["counts"], np.uint32).astype(np.int64)
    known = np.unpackbits(np.frombuffer(own["body"], np.uint8), count=int(counts.sum())).astype(bool)
    rest = frame[frame["kind"] == 0].sort_values("bucket")
    owners, bits = [np.empty(0, np.int64)], [np.empty(0, bool)]
    for k, c, b in zip(rest["keys"], rest["counts"], rest["body"]):
        c = np.frombuffer(c, np.uint32)
        owners.append(np.repeat(np.frombuffer(k, np.uint32).astype(np.int64), c))
        bits.append(np.unpackbits(np.frombuffer(b, np.uint8), count=int(c.sum())).astype(bool))
    owner, bit = np.concatenate(owners), np.concatenate(bits)
    order = np.argsort(owner, kind="stable")
    owner, bit = owner[order], bit[order]
    cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
    ends = np.r_[0, np.cumsum(counts)]
    out = []
    for d in range(len(ids)):
        mine, more = known[ends[d] : ends[d + 1]], bit[cuts[d] : cuts[d + 1]]
        if mine.any() or more.any():
            out.append((int(ids[d]), int(keys[d].view(np.int64)), np.packbits(mine).tobytes(), np.packbits(more).tobytes()))
    return pd.DataFrame(out, columns=["doc_id", "key", "known", "found"])


def runs(found: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of phrases that occur earlier, as (first, last) phrase."""
    edges = np.flatnonzero(np.diff(np.r_[False, found, False]))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _spans(body: bytes, known: bytes, found: bytes, least: int, buckets: int) -> list[tuple[int, int]]:
    """Word spans [start, end) of one document that occur in earlier ones."""
    hashes, first = _phrases(body, least)
    distinct = hashes[first]
    dup = np.unpackbits(np.frombuffer(known, np.uint8), count=len(distinct)).astype(bool)
    asked = np.flatnonzero(~dup)
    order = asked[np.argsort(_bucket(distinct[asked], buckets), kind="stable")]
    dup[order] = np.unpackbits(np.frombuffer(found, np.uint8), count=len(order)).astype(bool)
    by_hash = np.argsort(distinct)
    at = by_hash[np.searchsorted(distinct[by_hash], hashes)]
    spans: list[tuple[int, int]] = []
    for a, b in runs(dup[at]):
        if spans and a <= spans[-1][1]:  # starts inside the one before
            spans[-1] = (spans[-1][0], b + least)
        else:
            spans.append((a, b + least))
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 13, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans[, kept_text].

    Removes each word that a run of ``least`` words covers which also starts in a document of a smaller
    doc_id; runs are judged on the input. ``spans`` are [start, end) in words. Null counts
    as empty. Rows of a null doc_id are never smaller than others nor changed, and rows that repeat a
    doc_id are not earlier than one another. Other columns are ignored.
    """
    bodies = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("body"))
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    entries = _index_blocks(bodies, least, buckets)
    fields = entries.schema.simpleString()[7:-1].replace(":", " ")
    met = entries.groupBy("bucket").applyInPandas(_meet, fields)
    answers = met.groupBy("block").applyInPandas(_per_document, "doc_id bigint, key bigint, known binary, found binary")
    # One row per id. Rows that repeat an id are told apart by their text; equal ones have equal answers.
    per_id = answers.groupBy("doc_id").agg(F.collect_set(F.struct("key", "known", "found")).alias("answer"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: int, end: int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = body.split()
                spans = []
                key = int(np.uint64(xxhash.xxh3_64_intdigest(body)).view(np.int64)) if answer else None
                for bits in answer or []:
                    if bits["key"] == key:
                        spans = _spans(body, bits["known"], bits["found"], least, buckets)
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left = b" ".join(kept)
                row = (doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans])
                rows.append((*row, left.decode()) if keep_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: len(rows[0])])

    joined = bodies.join(per_id, "doc_id", "left")
    return joined.select("doc_id", "body", "answer").mapInArrow(run, schema + (", kept_text string" if keep_text else ""))
