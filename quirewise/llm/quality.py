"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade > k) = logistic(w . x - theta_k): one shared weight vector over 2**20 hashed features and one threshold
for each step between grades, kept in ascending order. Features are the distinct hashed words and neighbouring
pairs, the distinct shapes of words (case, digits, punctuation, length) and pairs of shapes, and hashed bands of
how repetitive and how dense the text is. A text without words has only its bands.

The expected grade is the lowest grade plus the sum of the tail probabilities times the steps between grades.
Null texts count as empty. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .texthash import hashed_words, mix, text_bytes
from .training import MAX_ROWS, fit, held_out, training_rows

BITS = 20
SIZE = 1 << BITS
RATE, DECAY, EPOCHS = 0.15, 1e-6, 4
#: Documents whose probability of being above the lowest grade is under this are rejected by selection.
LEAST_TAIL = 0.5
_PAIR, _SHAPE, _BAND = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_WHITE = [0x20, 9, 10, 11, 12, 13]


def _shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A small number for the look of each word of all texts, and each text's band numbers (rows of 4)."""
    data, offsets = text_bytes(texts)
    classes = _CLASS[data]
    space = np.isin(data, np.array(_WHITE, np.uint8))
    first = ~space
    first[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= ~space[edges]
    begin = np.flatnonzero(first)
    stop = np.append(np.flatnonzero(space), len(data))
    end = np.minimum(stop[np.searchsorted(stop, begin)], np.append(begin[1:], len(data)))
    if not len(begin):
        shape = np.zeros(0, np.int64)
    else:
        seen = np.bitwise_or.reduceat(classes, begin).astype(np.int64)
        shape = seen * 8 + np.minimum(np.log2(end - begin + 1).astype(np.int64), 7)
    length = np.diff(offsets)
    full = np.flatnonzero(length)
    shares = np.zeros((4, len(length)))
    if len(full):  # byte masks, summed text by text: nothing wider than a byte for each byte of text
        for row, mask in zip(shares, (space, classes == 8, classes == 1, classes == 4), strict=True):
            row[full] = np.add.reduceat(mask, offsets[full], dtype=np.int64) / length[full]
    return shape, np.minimum((shares * 24).astype(np.int64), 23).T


def features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    words, at = hashed_words(texts)
    shape, bands = _shapes(texts)
    down = np.uint64(64 - BITS)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    shape = mix(shape.astype(np.uint64) + _SHAPE)
    same = text[:-1] == text[1:]
    numbers, owners = [words, shape], [text, text]
    for values, factor in ((words, _PAIR), (shape, _SHAPE)):
        numbers.append(mix(values[:-1] * factor + values[1:])[same])
        owners.append(text[1:][same])
    count = np.diff(at)
    ordered = np.lexsort((words, text))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[ordered][1:] != words[ordered][:-1]) | (text[ordered][1:] != text[ordered][:-1])
    distinct = np.bincount(text[ordered][fresh], minlength=n) if len(words) else np.zeros(n, np.int64)
    again = np.bincount(text[1:][same & (words[1:] == words[:-1])], minlength=n) if len(words) > 1 else np.zeros(n, np.int64)
    scale = np.log2(count + 1).astype(np.int64)
    banded = [
        *bands.T, (distinct / np.maximum(count, 1) * 20).astype(np.int64) * 32 + scale,
        (again / np.maximum(count, 1) * 20).astype(np.int64), scale,
    ]
    for i, band in enumerate(banded):
        numbers.append(mix(band.astype(np.uint64) * np.uint64(64) + np.uint64(i) + _BAND))
        owners.append(np.arange(n))
    key = np.unique((np.concatenate(owners) << BITS) | (np.concatenate(numbers) >> down).astype(np.int64))
    return np.split(key & (SIZE - 1), np.searchsorted(key >> BITS, np.arange(1, n)))


@dataclass
class QualityModel:
    """Shared weights, ascending thresholds, and the grades they separate (one more than thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text (rows) and each threshold (columns)."""
        total = np.array([self.weights[x].sum() / np.sqrt(len(x)) for x in features(texts)])
        return _logistic(total[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit_shard(steps: int):
    """AdaGrad on the ordinal log-likelihood; the state is weights, thresholds and their squared-gradient sums."""

    def run(examples: list[tuple[int, np.ndarray]], state: np.ndarray) -> np.ndarray:
        state = state.astype(np.float64)
        w, theta, nw, nt = state[:SIZE], state[SIZE : SIZE + steps], state[SIZE + steps : -steps], state[-steps:]
        for label, x in examples * EPOCHS:
            if not len(x):
                continue
            scale = 1 / np.sqrt(len(x))
            above = _logistic(w[x].sum() * scale - theta)
            cum = np.concatenate([[1.0], above, [0.0]])  # P(grade >= k)
            p = max(cum[label] - cum[label + 1], 1e-9)
            slope = np.concatenate([[0.0], above * (1 - above), [0.0]])
            gw = -(slope[label] - slope[label + 1]) / p * scale
            gt = np.zeros(steps)
            if label > 0:
                gt[label - 1] = slope[label] / p
            if label < steps:
                gt[label] = -slope[label + 1] / p
            nw[x] += gw * gw
            w[x] -= RATE * (gw / (np.sqrt(nw[x]) + 1e-8) + DECAY * w[x])
            nt += gt * gt
            theta -= RATE * gt / (np.sqrt(nt) + 1e-8)
            theta.sort()
        return state

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Learn from at most ``max_rows`` rated documents outside the held-out fifth.

    Grades are the distinct ratings, which must be few; with fewer than two the model has no thresholds and
    everything is expected at the one grade (0 if there is none).
    """
    grades = sorted(
        r[0] for r in labels.select(F.col(label).cast("int")).filter(F.col(label).isNotNull()).distinct().limit(101).collect()
    )
    if len(grades) > 100:
        raise ValueError(f"{label} has over 100 distinct grades")
    steps = len(grades) - 1
    if steps < 1:
        return QualityModel(np.zeros(SIZE, np.float32), np.zeros(0), np.array(grades or [0]))
    rank = F.array_position(F.array(*map(F.lit, grades)), F.col(label).cast("int")) - 1
    ranked = labels.select("doc_id", F.when(F.col(label).isNotNull(), rank).alias("rank"))
    rows = training_rows(docs, ranked, "rank", features, max_rows, shards=1)
    start = np.zeros(2 * (SIZE + steps), np.float32)
    start[SIZE : SIZE + steps] = np.linspace(-0.5, 0.5, steps) if steps > 1 else 0
    state = fit(rows, _fit_shard(steps), start)
    return QualityModel(state[:SIZE], np.sort(state[SIZE : SIZE + steps].astype(np.float64)), np.array(grades))


def rate_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with expected_grade and tail_prob (of being above the lowest grade); same names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        tails = model.tails(part["text"])
        expected = model.grades[0] + tails @ np.diff(model.grades)
        least = tails[:, 0] if tails.shape[1] else np.ones(len(tails))
        return [pa.array(expected, pa.float64()), pa.array(least, pa.float64())]

    return add_columns(docs, "expected_grade double, tail_prob double", compute)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, held_out, expected_grade, tail_prob, selected."""
    rated = rate_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob",
        (F.col("tail_prob") >= LEAST_TAIL).alias("selected"),
    )
