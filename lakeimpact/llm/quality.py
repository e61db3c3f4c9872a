"""Quality by Bradley-Terry pairwise ranking.

Preference pairs (a good text over a bad one) train a linear score by logistic loss on the
difference of their features; the threshold is a quantile of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import rank_within
from ..session import Owned, Scratch
from . import grams
from .common import crc_mod

ORDERS, BITS = (1, 2, 3), 11
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KINDS = {  # share of the bytes
    "letter": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:!?'\"",
    "odd": bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\""),
    "high": bytes(range(128, 256)),
}


def features(body: bytes) -> np.ndarray:
    """N-grams of the whole text and a few of its proportions."""
    found = grams.shape(body.translate(_LOWER), ORDERS, BITS)
    n = len(body)
    words = body.split()
    lines = body.split(b"\n")
    extra = [np.sqrt((n - len(body.translate(None, chars))) / n) if n else 0.0 for chars in _KINDS.values()]
    extra += [
        len(set(words)) / len(words) if words else 0.0,
        len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) / len(words) / 20) if words else 0.0,
        np.log1p(len(words)) / 12,
        1.0 if words else 0.0,
    ]
    return np.concatenate([found, np.array(extra, np.float32)])


@dataclass
class QualityModel:
    weights: np.ndarray
    threshold: float  # raw score at the quantile
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rivals: int = 8,
    steps: int = 300,
    penalty: float = 1e-5,
    seed: int = 11,
) -> QualityModel:
    """Fit on all labelled rows, in blocks whose weights are averaged: each row of the more frequent label of a block
    is paired with ``rivals`` of the other, so that every row is in some pair.

    The threshold is the score quantile at the share of label 0 among all labelled rows, from the scores of them all. Rows whose
    label is neither 0 nor 1 are ignored; with one label only, every score is the same.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    docs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    with Owned() as mine:
        work = Scratch(docs.sparkSession, "quality")
        model = _fitted(docs, known, work, rivals, steps, penalty, seed)
    mine.release()
    return model


def _fitted(docs: DataFrame, known: DataFrame, work: Scratch, rivals: int, steps: int, penalty: float, seed: int) -> QualityModel:
    vectors = grams.labelled_vectors(docs, known, "_label", "_id", "_text", features, work)
    held = {r["label"]: r["count"] for r in vectors.groupBy("label").count().take(2)}
    if len(held) < 2:
        width = (1 << BITS) + len(_KINDS) + 5
        return QualityModel(np.zeros(width, np.float32), -1.0 if 1 in held else 1.0, 1.0)
    w = grams.fit_in_blocks(vectors, held, lambda x, y: _fit(x, y, rivals, steps, penalty, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [float(np.frombuffer(v, np.float16).astype(np.float32) @ w) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=["label", "raw"])

    scores = work.cut(vectors.select("label", "vector").mapInArrow(run, "label int, raw double"), "scores")
    means = {r["label"]: r["mean"] for r in scores.groupBy("label").agg(F.avg("raw").alias("mean")).take(2)}
    # The last score of the share of label 0, and the one after it.
    placed = rank_within(scores.select(F.lit(0).alias("_all"), "raw"), ["_all"], ["raw"], "place", work)
    at = [r["raw"] for r in placed.filter(F.col("place").isin(held[0], held[0] + 1)).take(2)]
    return QualityModel(w, float(np.mean(at)), float(abs(means[1] - means[0])) or 1.0)


def _fit(x: np.ndarray, y: np.ndarray, rivals: int, steps: int, penalty: float, seed: int) -> np.ndarray:
    """Weights of one block."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1], np.float32)
    draw = np.random.default_rng(seed)
    pairs = max(len(good), len(bad)) * rivals
    better, worse = np.resize(draw.permutation(good), pairs), np.resize(draw.permutation(bad), pairs)
    draw.shuffle(worse)

    def gradient(w):
        score = x @ w
        wrong = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -50, 50)))
        pull = np.bincount(worse, wrong, len(x)) - np.bincount(better, wrong, len(x))
        return (x.T @ (pull / pairs).astype(np.float32)) + penalty * w

    return grams.descend(gradient, np.zeros(x.shape[1], np.float32), 4.0, steps).astype(np.float32)


def judge(
    docs: DataFrame,
    model: QualityModel,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: dict[str, Column] | None = None,
    cut: float = 0.3,
    slope: float = 8.0,
) -> DataFrame:
    """One row per input row: doc_id, the ``keep`` columns, score (0 to 1), predicted.

    Reads the whole text and nothing else; null counts as empty, and an empty text is scored like
    any other. ``cut`` is the score of a text right at the model's quantile.
    """
    def rows_of(bodies):
        raw = model.raw(np.stack([features(b or b"") for b in bodies]))
        z = slope * (raw - model.threshold) / model.spread + np.log(cut / (1 - cut))
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return [(float(s), int(s >= cut)) for s in score]

    return grams.per_text(docs, doc_id, keep or {}, text, "score double, predicted int", rows_of)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def learn_and_judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels of rows that are not held out, then score every row."""
    model = train(docs.filter(~held_out()), labels.filter(~held_out()))
    return judge(docs, model, keep={"held_out": held_out()})
