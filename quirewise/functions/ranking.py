"""Scores of document batches against blocks of questions, inside Spark tasks.

A block is a bounded number of questions: their words with weights, their vectors, or both. Documents are scored against it
in dense slices of bounded size, and a task keeps only ``k`` rows per question, so all-pairs scores exist nowhere but in
those slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cosine import RunningTop, rounded, unit_rows

#: Cells of documents by questions, listed words, and listed words times their questions, that a task works on at a time.
SLICE_CELLS, SLICE_WORDS, SLICE_ASKED = 1 << 19, 1 << 18, 1 << 19
BLOCK_DOCUMENTS = 512
K1, B = 1.5, 0.75


@dataclass
class QuestionBlock:
    ids: list
    words: pa.Array  # distinct words of the block's questions
    starts: np.ndarray  # where each word's questions begin in the next two
    asked: np.ndarray
    weights: np.ndarray  # occurrences times inverse document frequency
    mean: float  # mean document length
    vectors: np.ndarray | None = None  # unit length; NaN where a question has none
    shares: np.ndarray | None = None  # weight of the vector and of the keyword ranking
    bounds: np.ndarray | None = None  # least and largest vector score, least and largest keyword score

    @classmethod
    def of(cls, rows: list[dict], mean: float) -> QuestionBlock:
        """From rows ``query_id, weights`` (of ``term, w``) and, for fused rankings, ``vector``, its shares and bounds."""
        listed = sorted((w["term"], i, w["w"]) for i, row in enumerate(rows) for w in row["weights"] or ())
        words, starts = [], []
        for at, (word, _, _) in enumerate(listed):
            if not words or words[-1] != word:
                words.append(word)
                starts.append(at)
        block = cls(
            [row["query_id"] for row in rows], pa.array(words, pa.string()), np.array([*starts, len(listed)], np.int64),
            np.array([r[1] for r in listed], np.int64), np.array([r[2] for r in listed], np.float64), mean or 1.0,
        )
        if rows and "vector" in rows[0]:
            dim = max((len(row["vector"]) for row in rows if row["vector"]), default=0)
            none = np.full(dim, np.nan)
            given = [np.array(row["vector"], np.float64) if row["vector"] else none for row in rows]
            block.vectors = unit_rows(np.array(given).reshape(len(rows), dim))
            block.shares = np.array([(row["vector_weight"], row["keyword_weight"]) for row in rows], np.float64).reshape(-1, 2).T
        if rows and "low_v" in rows[0]:
            bounds = [[0.0 if row[c] is None else row[c] for c in ("low_v", "high_v", "low_t", "high_t")] for row in rows]
            block.bounds = np.array(bounds, np.float64).T
        return block

    def without(self, dead: np.ndarray) -> QuestionBlock:
        """The same questions, less the words of those that are ``dead``."""
        live = ~dead[self.asked]
        starts = np.append(0, np.cumsum(live))[self.starts]
        return replace(self, starts=starts, asked=self.asked[live], weights=self.weights[live])


@dataclass
class Listed:
    """The words of some documents that a block's questions ask for: word, document and the weight's factor of each."""

    word: np.ndarray
    document: np.ndarray
    part: np.ndarray
    count: int

    @classmethod
    def of(cls, block: QuestionBlock, lengths: np.ndarray, postings: pa.ListArray) -> Listed:
        sizes = pc.fill_null(pc.list_value_length(postings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = postings.flatten()
        word = pc.fill_null(pc.index_in(flat.field("term"), block.words), -1).to_numpy(zero_copy_only=False)
        document = np.repeat(np.arange(len(postings)), sizes)
        known = word >= 0
        word, document, tf = word[known], document[known], flat.field("tf").to_numpy(zero_copy_only=False)[known]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[document] / block.mean))
        return cls(word, document, part, len(postings))

    def between(self, a: int, b: int) -> Listed:
        lo, hi = np.searchsorted(self.document, [a, b])
        return Listed(self.word[lo:hi], self.document[lo:hi] - a, self.part[lo:hi], b - a)

    def scores(self, block: QuestionBlock) -> np.ndarray:
        """Okapi BM25, documents by questions, rounded; NaN where a document has none of a question's words.

        A word stands for as many numbers as questions ask for it, so documents are summed up a bounded number of these at a time.
        """
        each = block.starts[self.word + 1] - block.starts[self.word]
        reach = np.append(0, np.cumsum(np.bincount(self.document, each, self.count)))
        out, a = np.empty((self.count, len(block.ids))), 0
        while a < self.count:
            b = max(a + 1, int(np.searchsorted(reach, reach[a] + SLICE_ASKED, "right")) - 1)
            out[a:b] = self.between(a, b)._summed(block)
            a = b
        return out

    def _summed(self, block: QuestionBlock) -> np.ndarray:
        each = block.starts[self.word + 1] - block.starts[self.word]
        at = np.repeat(block.starts[self.word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        cell = np.repeat(self.document, each) * len(block.ids) + block.asked[at]
        total = np.bincount(cell, block.weights[at] * np.repeat(self.part, each), self.count * len(block.ids))
        return np.where(total > 0, rounded(total), np.nan).reshape(self.count, len(block.ids))

    def largest(self, block: QuestionBlock) -> np.ndarray:
        """For each question the sum of its words' largest parts: no document of these scores more."""
        most = np.zeros(len(block.words))
        np.maximum.at(most, self.word, self.part)
        owner = np.repeat(np.arange(len(block.words)), np.diff(block.starts))
        return np.bincount(block.asked, block.weights * most[owner], len(block.ids))


def keyword_scores(block: QuestionBlock, lengths: np.ndarray, postings: pa.ListArray) -> np.ndarray:
    return Listed.of(block, lengths, postings).scores(block)


def vector_scores(block: QuestionBlock, vectors: pa.ListArray) -> np.ndarray:
    """Cosines, documents by questions, rounded; NaN where either side has no usable vector."""
    dim = block.vectors.shape[1]
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    out = np.full((len(vectors), len(block.ids)), np.nan)
    if len(rows) and dim:
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[rows] = rounded(unit_rows(flat.reshape(len(rows), dim)) @ block.vectors.T)
    return out


def _slices(batch: pa.RecordBatch, questions: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE_CELLS // max(1, questions))
    listed = pc.fill_null(pc.list_value_length(batch["postings"]), 0).to_numpy(zero_copy_only=False)
    reach, at = np.append(0, np.cumsum(listed, dtype=np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + step, int(np.searchsorted(reach, reach[at] + SLICE_WORDS, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def _both(block: QuestionBlock, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(part["doc_len"], 0).to_numpy(zero_copy_only=False)
    return vector_scores(block, part["embedding"]), keyword_scores(block, lengths, part["postings"])


def _unit(scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scores mapped to 0..1 by each question's bounds; equal bounds map to 1, no score to 0."""
    spread = np.where(high > low, high - low, 1.0)
    return np.where(np.isnan(scores), 0.0, np.where(high > low, (scores - low) / spread, 1.0))


def bounds_of(batches: Iterator[pa.RecordBatch], block: QuestionBlock) -> Iterator[list[tuple]]:
    """(question id, least and largest vector score, least and largest keyword score) of a task's rows."""
    seen = np.full((4, len(block.ids)), np.nan)
    for batch in batches:
        for part in _slices(batch, len(block.ids)):
            for at, scores in enumerate(_both(block, part)):
                seen[2 * at] = np.fmin(seen[2 * at], np.fmin.reduce(scores, axis=0))
                seen[2 * at + 1] = np.fmax(seen[2 * at + 1], np.fmax.reduce(scores, axis=0))
    yield [(q, *(None if np.isnan(x) else float(x) for x in column)) for q, column in zip(block.ids, seen.T, strict=True)]


def best_keywords(
    batches: Iterator[pa.RecordBatch], block: QuestionBlock, k: int, report: Callable[[int, int], None] | None = None
) -> Iterator[list[tuple]]:
    """(question id, document id, score): a task's best ``k`` by keyword score.

    Documents come in blocks. A block whose largest possible score for a question is under that question's k-th
    best so far is not scored for it. ``report`` is told of how many (document, question) cells, and how many were left out.
    """
    top = RunningTop(len(block.ids), k)
    least = np.full(len(block.ids), -np.inf)
    for batch in (part for whole in batches for part in _slices(whole, len(block.ids))):
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        listed = Listed.of(block, batch["doc_len"].to_numpy(zero_copy_only=False), batch["postings"])
        step = max(1, min(BLOCK_DOCUMENTS, SLICE_CELLS // max(1, len(block.ids))))
        for at in range(0, len(ids), step):
            some = listed.between(at, min(len(ids), at + step))
            dead = some.largest(block) < least - 1e-6  # scores are rounded to six digits
            if report is not None:
                report(some.count * len(dead), some.count * int(dead.sum()))
            if dead.all():
                continue
            scores = some.scores(block.without(dead) if dead.any() else block)
            with np.errstate(invalid="ignore"):
                better = scores >= least
            for q in np.flatnonzero(better.any(axis=0)):
                rows = np.flatnonzero(better[:, q])
                top.offer(q, scores[rows, q], ids[at + rows])
                if len(top.scores[q]) == k:
                    least[q] = top.scores[q][-1]
    yield _found(block, top)


def best_fused(batches: Iterator[pa.RecordBatch], block: QuestionBlock, k: int) -> Iterator[list[tuple]]:
    """(question id, document id, score): a task's best ``k`` by the weighted sum of both scores within the block's bounds."""
    top = RunningTop(len(block.ids), k)
    for batch in batches:
        for part in _slices(batch, len(block.ids)):
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            v, t = _both(block, part)
            fused = block.shares[0] * _unit(v, *block.bounds[:2]) + block.shares[1] * _unit(t, *block.bounds[2:])
            scores = np.where(np.isnan(v) & np.isnan(t), np.nan, rounded(fused))
            for q in np.flatnonzero(~np.isnan(scores).all(axis=0)):
                rows = np.flatnonzero(~np.isnan(scores[:, q]))
                top.offer(q, scores[rows, q], ids[rows])
    yield _found(block, top)


def _found(block: QuestionBlock, top: RunningTop) -> list[tuple]:
    return [
        (block.ids[q], document, float(score))
        for q in range(len(block.ids)) if top.ids[q] is not None
        for document, score in zip(top.ids[q].tolist(), top.scores[q], strict=True)
    ]
