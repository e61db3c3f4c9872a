"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit, a logistic regression on hashed
byte n-grams, predicts that bit; the language whose codeword costs the least logistic loss wins.
Where the two nearest codewords are about as near, the row is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F

from . import grams
from .common import crc_mod

ORDERS, BITS = (2, 3, 4), 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# Letters as they are, in lower case; whatever else ASCII has counts as a gap.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(body: bytes) -> np.ndarray:
    return grams.shape(b" " + b" ".join(body.translate(_LETTERS).split()) + b" ", ORDERS, BITS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: every split of up to 7 languages, else random ones far apart."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 7:
        columns = [[1] + [1 if c >> k & 1 else -1 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float32).T
    draw = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))

    def apart(code):  # the smallest distance of two codewords; no column may be constant
        near = (width - code @ code.T) / 2 + np.eye(n) * width
        return near.min() if (abs(code.sum(axis=0)) < n).all() else -1

    return max((draw.choice(np.array([-1, 1], np.float32), (n, width)) for _ in range(64)), key=apart)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Logistic loss of each codeword, summed over its bits."""
        said = x @ self.weights + self.bias
        return np.logaddexp(0, -said[:, None, :] * self.code[None, :, :]).sum(axis=2)


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most_per_language: int = 1000,
    steps: int = 150,
    penalty: float = 1e-4,
) -> LanguageModel:
    """Fit on at most ``most_per_language`` rows per language with a non-null language and text with a letter,
    ``grams.MOST_ROWS`` in all.

    More than ``grams.MOST_LABELS`` languages among them raise ValueError.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(doc_id, text, lang)
    x, y, _ = grams.labelled_sample(rows, lang, doc_id, text, most_per_language, features)
    languages = sorted(set(y))
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32))
    code = codewords(len(languages))
    index = np.searchsorted(languages, y)
    signs = code[index]  # rows x bits
    # Languages weigh alike, whatever their rows.
    weight = (1.0 / np.bincount(index)[index] / len(languages)).astype(np.float32)[:, None]

    def gradient(w):  # the last row of w is the bias
        found = penalty * w
        for at in range(0, len(x), 1024):
            some = slice(at, at + 1024)
            wrong = 1 / (1 + np.exp(np.clip(signs[some] * (x[some] @ w[:-1] + w[-1]), -50, 50)))
            pull = weight[some] * wrong * signs[some]
            found[:-1] -= x[some].T @ pull
            found[-1] -= pull.sum(axis=0)
        return found

    w = grams.descend(gradient, np.zeros((x.shape[1] + 1, code.shape[1]), np.float32), 2.0, steps).astype(np.float32)
    return LanguageModel(languages, code, w[:-1], w[-1])


def identify(
    docs: DataFrame,
    model: LanguageModel,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: dict[str, Column] | None = None,
    clear: float = 0.5,
) -> DataFrame:
    """One row per input row: doc_id, the ``keep`` columns, lang_pred, score, runner_up, ambiguous.

    Reads the whole text and nothing else. ``und`` with score 0 where the text is null, has no letter,
    or nothing was learned. The score is the winner's share when codewords weigh exp(-loss);
    below ``clear`` the row is ambiguous. Ties go to the first language in code point order.
    """
    def rows_of(bodies):
        known = [b is not None and bool(model.languages) and _LETTER.search(b.decode()) is not None for b in bodies]
        out = [(UNKNOWN, 0.0, None, True)] * len(bodies)
        if any(known):
            at = [i for i, k in enumerate(known) if k]
            loss = model.losses(np.stack([features(bodies[i]) for i in at]))
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            order = np.argsort(loss, axis=1, kind="stable")
            for i, ranks, p in zip(at, order, share):
                second = model.languages[ranks[1]] if len(ranks) > 1 else None
                out[i] = (model.languages[ranks[0]], float(p[ranks[0]]), second, bool(p[ranks[0]] < clear))
        return [(a, b, c or "", d) for a, b, c, d in out]

    schema = "lang_pred string, score double, runner_up string, ambiguous boolean"
    return grams.per_text(docs, doc_id, keep or {}, text, schema, rows_of)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, then predict every row."""
    model = train(docs.filter(~held_out()))
    return identify(docs, model, keep={"held_out": held_out()})
