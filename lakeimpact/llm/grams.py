"""Hashed byte n-grams of whole texts as dense vectors, fits over all labelled ones, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch, stored
from .bitfilter import bits_for, filter_from
from .common import give_back_memory

_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
_KNUTH = np.uint32(2654435761)


def counts(body: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often the n-grams of each order (1 to 4) fall into each of 2**bits bins."""
    total = np.zeros(1 << bits, np.int64)
    # Pieces keep the temporary arrays small; they overlap so that no n-gram is lost.
    for at in range(0, len(body), 1 << 20):
        piece = np.frombuffer(body, np.uint8, min(len(body) - at, (1 << 20) + 3), at).astype(np.uint32)
        for n in orders:
            starts = min(len(piece) - n + 1, 1 << 20)
            if starts <= 0:
                continue
            v = piece[:starts].copy()
            for j in range(1, n):
                v |= piece[j : starts + j] << np.uint32(8 * j)
            v += np.uint32(n * 0x3C6EF35F & 0xFFFFFFFF)
            v *= _KNUTH
            v >>= np.uint32(32 - bits)
            total += np.bincount(v, minlength=1 << bits)
    return total


def shape(body: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Square roots of the n-gram shares: a vector of length 1, or 0 if there is no n-gram."""
    found = counts(body, orders, bits)
    every = found.sum()
    return np.sqrt(found / every).astype(np.float32) if every else found.astype(np.float32)


MOST_LABELS, MOST_ROWS = 1000, 16_000


def labelled_sample(
    rows: DataFrame, label: str, doc_id: str, text: str, most: int, features: Callable[[bytes], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, dict]:
    """Vectors and labels of about ``most`` rows per label; row counts per label.

    With many labels there are fewer of each, ``MOST_ROWS`` in all, so that the driver holds a bounded number of
    vectors. Rows are chosen by a hash of their id and text, so that the same input gives the same sample;
    whole texts are turned to vectors on the executors. A model has a class per label, so more than
    ``MOST_LABELS`` of them are refused.
    """
    held = {r[0]: r[1] for r in rows.groupBy(label).count().take(MOST_LABELS + 1)}
    if len(held) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    if not held:
        return np.zeros((0, 0), np.float32), np.zeros(0, object), held
    most = max(1, min(most, MOST_ROWS // len(held)))
    kind = rows.schema[label].dataType.simpleString()
    shares = [(value, min(1.0, most / n)) for value, n in held.items()]
    # Stored, so that its size is known and the texts stay where they are.
    shares = stored(rows.sparkSession.createDataFrame(shares, f"_label {kind}, _share double"), "shares")
    rows = rows.select(F.col(label).alias("_of"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(shares, F.col("_of") == F.col("_label")).filter(draw < F.col("_share"))
    chosen = chosen.select("_label", F.coalesce("_text", F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                vectors = [features(b).astype(np.float16).tobytes() for b in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.binary())], names=["label", "vector"])

    got = chosen.mapInArrow(run, f"label {kind}, vector binary").take(most * len(held))
    got.sort(key=lambda r: (r["label"], r["vector"]))  # tasks finish in any order
    x, y = np.empty((len(got), len(got[0]["vector"]) // 2 if got else 0), np.float32), np.empty(len(got), object)
    for i, r in enumerate(got):
        x[i], y[i], got[i] = np.frombuffer(r["vector"], np.float16), r["label"], None  # one copy is enough
    return x, y, held


def labelled_vectors(
    docs: DataFrame, known: DataFrame, label: str, doc_id: str, text: str, features: Callable[[bytes], np.ndarray], work: Scratch
) -> DataFrame:
    """(label, deal, vector) of every row of ``docs`` per row of ``known`` with its id, as a table of ``work``.

    Vectors are made where texts are read, so no text is exchanged. Bits of the ids of ``known`` leave out most rows
    without a label before that. ``deal`` is a hash of id and text, another one for each copy of a row.
    """
    known = work.cut(known.select(F.col(doc_id).alias("_id"), F.col(label).alias("label")), "known")
    bits = bits_for(known.count())
    filter_ = filter_from(known.select(F.shiftrightunsigned(F.xxhash64("_id"), 64 - bits).alias("place")), bits)
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(doc_id).alias("_hash"), F.xxhash64(doc_id, text).alias("_key"), body.alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[int, int] = {}
        for batch in batches:
            wanted = filter_.has(batch.column(1).to_numpy().view(np.uint64))
            some = pa.Table.from_batches([batch]).filter(pa.array(wanted)).combine_chunks()
            for at in range(0, some.num_rows, 200):
                part = some.slice(at, 200)
                deals = []
                for key in part.column(2).to_pylist():
                    copies[key] = again = copies.get(key, -1) + 1
                    deals.append((key + again * 0x9E3779B97F4A7C15) >> 1 & 0x3FFFFFFFFFFFFFFF)
                vectors = [features(b).astype(np.float16).tobytes() for b in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).combine_chunks(), pa.array(deals, pa.int64()), pa.array(vectors, pa.binary())],
                    names=["_id", "deal", "vector"],
                )

    found = rows.mapInArrow(run, f"_id {kind}, deal bigint, vector binary")
    return work.cut(found.join(known, "_id").select("label", "deal", "vector"), "vectors")


# Rows of a block, and the least number of each label among them where there are that many.
BLOCK, LEAST = 4000, 50
_UNIT = 2.0**32


def fit_in_blocks(vectors: DataFrame, held: dict, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of the weights that ``fit`` finds in each block of about ``BLOCK`` vectors; all vectors are in one.

    ``held`` has the number of vectors by label. Rows of a label that is rare go to as many blocks as it takes for each to have
    some of it. The mean is taken by Spark in whole units, so that the order in which blocks end is of no consequence.
    """
    blocks = max(1, sum(held.values()) // BLOCK)
    copies = F.lit(1)
    for value, n in held.items():
        if n < LEAST * blocks:
            copies = F.when(F.col("label") == F.lit(value), min(blocks, -(-LEAST * blocks // n))).otherwise(copies)
    dealt = vectors.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    dealt = dealt.select("label", "vector", F.pmod(F.col("deal") + F.col("copy"), F.lit(blocks)).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        # Rows arrive in any order.
        rows = sorted(zip(table.column("label").to_pylist(), table.column("vector").to_pylist()))
        x = np.empty((len(rows), len(rows[0][1]) // 2), np.float32)
        for i, (_, vector) in enumerate(rows):
            x[i] = np.frombuffer(vector, np.float16)
        w = fit(x, np.array([label for label, _ in rows], object)).astype(np.float64)
        return pa.table({"weights": pa.array([w.tolist()], pa.list_(pa.float64()))})

    found = dealt.groupBy("block").applyInArrow(run, "weights array<double>")
    found = found.select(F.posexplode("weights").alias("at", "weight"))
    found = found.groupBy("at").agg(F.sum(F.round(F.col("weight") * _UNIT).cast("bigint")).alias("sum"), F.count("weight").alias("n"))
    mean = {r["at"]: r["sum"] / r["n"] / _UNIT for r in found.toLocalIterator()}
    return np.array([mean[i] for i in range(len(mean))], np.float32)


def descend(gradient: Callable[[np.ndarray], np.ndarray], w: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """Gradient descent with Nesterov's momentum."""
    ahead, last = w, w
    for k in range(steps):
        w = ahead - rate * gradient(ahead)
        ahead = w + k / (k + 3) * (w - last)
        last = w
    return w


def per_text(
    docs: DataFrame, doc_id: str, keep: dict[str, Column], text: str, schema: str, rows_of: Callable[[list], list[tuple]]
) -> DataFrame:
    """doc_id and ``keep`` columns plus what ``rows_of`` says about each batch of texts (bytes or None)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *keep]
    chosen = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text).cast("binary").alias("_body"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:-1])
    out, types = zip(*(part.strip().rsplit(" ", 1) for part in schema.split(",")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                said = list(zip(*rows_of(some.column(len(names)).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i) for i in range(len(names))), *(pa.array(c, _ARROW[t]) for c, t in zip(said, types))],
                    names=[*names, *out],
                )
        give_back_memory()

    return chosen.mapInArrow(run, f"doc_id {kind}, {kept + ', ' if kept else ''}{schema}")
