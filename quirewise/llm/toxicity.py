"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, neighbouring pairs and pairs with one word between, into 2**20
numbers; a text without words has only the bias. Learning rates are kept per coordinate and an L1 term keeps
most weights at zero, so what scoring broadcasts is a short list of (number, weight) of proven size.
Null and empty texts score the bias. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .texthash import hashed_words, mix
from .training import MAX_ROWS, fit, held_out, training_rows

BITS = 20
BIAS = 1 << BITS
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 1.0
EPOCHS = 6
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and text number of every word, pair and skip-pair."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    down = np.uint64(64 - BITS)
    numbers, owners = [words >> down], [text]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        if len(words) > gap:
            same = text[:-gap] == text[gap:]
            numbers.append((mix(words[:-gap] * factor + words[gap:]) >> down)[same])
            owners.append(text[gap:][same])
    return np.concatenate(numbers).astype(np.int64), np.concatenate(owners)


def features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text, without the bias."""
    number, owner = _grams(*hashed_words(texts))
    key = np.unique((owner << BITS) | number)
    return np.split(key & (BIAS - 1), np.searchsorted(key >> BITS, np.arange(1, len(texts))))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _ftrl(examples: list[tuple[int, np.ndarray]], state: np.ndarray) -> np.ndarray:
    z, n = state.reshape(2, BIAS + 1).astype(np.float64)
    for label, x in examples * EPOCHS:
        x = np.append(x, BIAS)
        w = _weights(z[x], n[x])
        w[-1] = -z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA)  # the bias carries no penalty
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA * w
        n[x] += g * g
    return np.stack([z, n])


class ToxicityModel:
    """Sparse weights: ``numbers`` (sorted), ``values`` and ``bias``."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray, bias: float):
        self.numbers, self.values, self.bias = numbers, values, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(BIAS)
        dense[self.numbers] = self.values
        number, owner = _grams(*hashed_words(texts))
        live = np.flatnonzero(dense[number])
        key = np.unique((owner[live] << BITS) | number[live])
        total = np.bincount(key >> BITS, dense[key & (BIAS - 1)], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fifth.

    Without any usable label the model is all zero and every score is 0.5.
    """
    # one shard: the mean of several z falls under the L1 threshold where a single shard has seen a feature
    rows = training_rows(docs, labels, "toxic", features, max_rows, shards=1)
    state = fit(rows, _ftrl, np.zeros(2 * (BIAS + 1), np.float32))
    z, n = state.reshape(2, BIAS + 1).astype(np.float64)
    w = _weights(z[:BIAS], n[:BIAS])
    numbers = np.flatnonzero(w)
    return ToxicityModel(numbers, w[numbers], float(-z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxic_score") -> DataFrame:
    """``docs`` with the score in ``column``, which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, f"`{column}` double", lambda part: [pa.array(shared.value.scores(part["text"]), pa.float64())])


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, held_out, score, predicted."""
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
