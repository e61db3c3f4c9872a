"""Byte-level BPE encoding and decoding over documents, by a rank file.

Each match of the splitting pattern is merged on its own with a hierarchical-bitmap rank queue:
one bucket of positions per merge rank, a bitmap over ranks and one above it, so that the next
rank is two find-first-set steps away. Positions link to their neighbours; an entry
whose pair has changed since is stale and skipped. Work is n log-free steps for a match of n bytes,
so a match of a million letters is as cheap per byte as a short one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import give_back_memory, hold_between_tasks

_MASKS = [1 << b for b in range(256)]
# A match of so many bytes at most has its positions in one small number.
SHORT = 64
_AFTER, _BEFORE = [*range(1, SHORT + 1)], [*range(-1, SHORT - 1)]


class Bpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    # Distinct units and matches kept per worker, of which those not met for long go first; one of many tokens counts as
    # several. A smaller number costs time only. What is longer than LONG hardly comes back.
    REMEMBERED = 1_000_000
    LONG = 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # Every way to join two tokens to a third, by both ranks.
        self.joined = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.single = [ranks[bytes([b])] for b in range(256)]
        # The same by the left token, then the right one, and for two bytes.
        none: dict[int, int] = {}
        self.joined_to = [none] * (max(self.tokens) + 1)
        for key, rank in self.joined.items():
            if not self.joined_to[key >> 32]:
                self.joined_to[key >> 32] = {}
            self.joined_to[key >> 32][key & 0xFFFFFFFF] = rank
        self.joined_bytes = {(*token,): rank for token, rank in ranks.items() if len(token) == 2}.get
        self.no_words = [0] * ((max(self.tokens) >> 8) + 1)
        self.masks = [1 << b for b in range(max(256, len(self.no_words)))]
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern)
        # White space as the pattern means it (Unicode's property, without U+001C to U+001F).
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        # No match of the pattern goes from a visible character on to white space, so text
        # can be cut there, and each unit be split and merged once.
        self.units = re.compile(f"[{space}]*[^{space}]+|[{space}]+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.former: dict[str, tuple[int, ...]] = {}
        self.weight = 0  # of what is in known

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: lowest rank first, leftmost first.

        The queue: ``buckets`` holds positions by rank; bit b of ``low[w]`` says that rank
        256 w + b has a bucket, bit w of ``top`` that ``low[w]`` is not 0.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= SHORT:
            return self._merge_short(piece)
        rank_of, masks, n = self.joined.get, _MASKS, len(piece)
        ids = [*map(self.single.__getitem__, piece)]  # of the token that starts at i
        after = list(range(1, n + 1))  # where the next token starts
        before = list(range(-1, n - 1))
        pair = [*map(rank_of, [a << 32 | b for a, b in zip(ids, ids[1:])]), None]  # as last seen
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    if word in low:
                        low[word] |= masks[rank & 255]
                    else:
                        low[word] = masks[rank & 255]
                        top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bits &= bits - 1
            if bits:
                low[word] = bits
            else:
                del low[word]
                top &= top - 1
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            k = 0
            for i in places:
                k += 1
                if pair[i] != rank:  # stale
                    continue
                middle = after[i]
                ids[i] = rank
                end = after[i] = after[middle]
                pair[middle] = None
                sooner = False
                if end < n:
                    before[end] = i
                    new = pair[i] = rank_of(rank << 32 | ids[end])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            sooner = new < rank
                            word = new >> 8
                            if word in low:
                                low[word] |= masks[new & 255]
                            else:
                                low[word] = masks[new & 255]
                                top |= 1 << word
                else:
                    pair[i] = None
                left = before[i]
                if left >= 0:
                    new = pair[left] = rank_of(ids[left] << 32 | rank)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            sooner = sooner or new < rank
                            word = new >> 8
                            if word in low:
                                low[word] |= masks[new & 255]
                            else:
                                low[word] = masks[new & 255]
                                top |= 1 << word
                if sooner and k < len(places):  # a lower rank appeared: the others wait
                    buckets[rank] = places[k:]
                    word = rank >> 8
                    low[word] = low.get(word, 0) | masks[rank & 255]
                    top |= 1 << word
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same queue for a match of at most SHORT bytes: a bucket is a bitmap of its positions, whose lowest bit is
        the next one, ``low`` is a list of all words, and it ends with the last pair that is not stale."""
        joined, n = self.joined_to, len(piece)
        ids = [*map(self.single.__getitem__, piece)]  # of the token that starts at i, None inside of one
        after, before = _AFTER[:n], _BEFORE[:n]
        pair = [*map(self.joined_bytes, zip(piece, piece[1:])), None]  # as last seen
        buckets: dict[int, int] = {}
        low = self.no_words.copy()
        top = 0
        masks = self.masks
        for rank, place in zip(pair, masks):
            if rank is not None:
                if rank in buckets:
                    buckets[rank] |= place
                else:
                    buckets[rank] = place
                    low[rank >> 8] |= masks[rank & 255]
                    top |= masks[rank >> 8]
        open_pairs = n - pair.count(None)
        while open_pairs:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            places = buckets.pop(rank)
            i = (places & -places).bit_length() - 1
            places &= places - 1
            if places:
                buckets[rank] = places
            else:
                low[word] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            if pair[i] != rank:  # stale
                continue
            open_pairs -= 1
            middle = after[i]
            ids[i] = rank
            ids[middle] = None
            end = after[i] = after[middle]
            if end < n:
                before[end] = i
                if pair[middle] is not None:
                    pair[middle] = None
                    open_pairs -= 1
                new = pair[i] = joined[rank].get(ids[end])
                if new is not None:
                    open_pairs += 1
                    if new in buckets:
                        buckets[new] |= masks[i]
                    else:
                        buckets[new] = masks[i]
                        low[new >> 8] |= masks[new & 255]
                        top |= masks[new >> 8]
            else:
                pair[i] = None
            if i:
                left = before[i]
                if pair[left] is not None:
                    open_pairs -= 1
                new = pair[left] = joined[ids[left]].get(rank)
                if new is not None:
                    open_pairs += 1
                    if new in buckets:
                        buckets[new] |= masks[left]
                    else:
                        buckets[new] = masks[left]
                        low[new >> 8] |= masks[new & 255]
                        top |= masks[new >> 8]
        return [rank for rank in ids if rank is not None]

    def _keep(self, unit: str, found: tuple[int, ...]) -> None:
        """Remember a unit. When half of what may be kept is new, what was not met since the half before goes."""
        self.weight += 1 + len(found) // 16
        if self.weight > self.REMEMBERED // 2:
            self.former = self.known.copy()
            self.known.clear()
            self.weight = 1
        self.known[unit] = found

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit not met before, or not for long."""
        found = self.former.pop(unit, None)
        if found is None:
            matches = self.split.findall(unit)
            if len(matches) == 1:
                found = tuple(self.merge(unit.encode()))
            else:
                ids: list[int] = []
                for match in matches:
                    part = self.known.get(match) or self.former.get(match)
                    if part is None:
                        part = tuple(self.merge(match.encode()))
                        if len(match) <= self.LONG:
                            self._keep(match, part)
                    ids += part
                found = tuple(ids)
        if len(unit) <= self.LONG:
            self._keep(unit, found)
        return found

    def encode(self, text: str) -> list[int]:
        known, unit = self.known, self._unit
        ids: list[int] = []
        for u in self.units.findall(text):
            ids += known.get(u) or unit(u)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    absent = [b for b in range(256) if bytes([b]) not in ranks]
    if absent:
        raise ValueError(f"{path} lacks single bytes: {absent[:5]}")
    return ranks


@lru_cache(maxsize=2)
def _loaded(name: str, pattern: str, remembered: int) -> Bpe:
    """One coder per Python worker, kept between tasks."""
    coder = Bpe(read_ranks(SparkFiles.get(name)), pattern)
    coder.REMEMBERED = remembered
    return coder


def encode_decode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    remembered: int = Bpe.REMEMBERED,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes[, ids, decoded].

    Encodes each whole text (null: empty, no tokens) without special tokens, then decodes
    the ids. The digests are those of the ids in decimal joined by commas and of the decoded
    bytes; ``with_ids`` adds the ids and decoded text. Repeated rows, null ids and
    further columns are of no consequence. ``remembered`` bounds the memory of matches of a worker (some 280 MB
    for a million) and is of no consequence but for time. The rank file is shipped to every executor by Spark.
    """
    docs.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    kind = docs.schema[doc_id].dataType.simpleString()
    extra = ", ids array<int>, decoded binary" if with_ids else ""
    schema = (
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint{extra}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory("bpe")
        coder = _loaded(name, pattern, remembered)
        hold_between_tasks("bpe", _loaded.cache_clear)
        gc.disable()  # a million small tuples and no cycles
        try:
            yield from coded(coder, batches)
        finally:
            gc.enable()

    def coded(coder: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                ids = coder.encode(body)
                decoded = coder.decode(ids)
                written = ",".join(map(coder.decimal.__getitem__, ids)).encode()
                row = [len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)]
                rows.append(row + [ids, decoded] if with_ids else row)
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            if not columns:
                continue
            if with_ids:
                columns[4], columns[5] = pa.array([r[4] for r in rows], pa.list_(pa.int32())), pa.array([r[5] for r in rows], pa.binary())
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names[: len(columns)]])

    bodies = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return bodies.mapInArrow(run, schema)
