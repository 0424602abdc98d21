"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and a fast Hadamard transform. A row is filed in a table under
the signed axes nearest to it, a query probes the axes nearest to it there, and the buckets they share bring them together. Rows
met so often that of unlike rows only a SHARE would be are candidates, scored exactly on the original vectors. Codes do not depend on lengths, so candidates are taken in bands of similar length: the largest inner
products of a band are those of the smallest angles. Where fewer than POOL times the rows asked for are met that often in a band,
as many of those met most often count; only a band with fewer rows in shared buckets than that is scored whole.

All rows are hashed; nothing is fitted. Rows are dealt into splits by their place, so a bucket that holds very many is
spread over all of them; a split's buckets are lists of its own rows, and queries stream past it
(``functions/streams.py``). An id that is null takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.streams import SPLIT_ROWS, against_all
from ..session import materialize
from .tiles import best, usable

#: Hash tables, and the signed axes that a row is filed under and a query probes in each: one in AXES_A_PROBE of all at least.
TABLES, PROBES, AXES_A_PROBE = 64, 2, 64
#: Share of rows without any likeness to a query that may be met often enough to be candidates, and the candidates
#: that a band gives at least, for each row asked for.
SHARE, POOL = 0.1, 8
#: Ratio of the lengths of a band.
BAND = 1.1


def _signs(n: int) -> np.ndarray:
    """The Hadamard matrix of a power of two."""
    out = np.ones((1, 1))
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of every row in two steps of about the square root of its length."""
    n = x.shape[1]
    a = 1 << (n.bit_length() - 1) // 2
    b = n // a
    y = (x.reshape(-1, b) @ _signs(b)).reshape(-1, a, b).transpose(0, 2, 1)
    return (np.ascontiguousarray(y).reshape(-1, a) @ _signs(a)).reshape(-1, b, a).transpose(0, 2, 1).reshape(len(x), n)


def rotations(x: np.ndarray, tables: int, seed: int = 20) -> Iterator[np.ndarray]:
    """Pseudo-rotated copies of the rows of ``x``, padded to a power of two; all positive scales are alike."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    random = np.random.default_rng([seed, size])
    for _ in range(tables):
        turned = padded
        for _ in range(3):
            turned = _hadamard(turned * random.choice([-1.0, 1.0], size))
        yield turned


def nearest_axes(x: np.ndarray, tables: int, count: int) -> np.ndarray:
    """Numbers (table by table, 2 * axis, and one more on its negative side) of the signed axes nearest to each row, ``count`` a table."""
    out = []
    for table, turned in enumerate(rotations(x, tables)):
        both = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
        some = min(max(count, both.shape[1] // AXES_A_PROBE), both.shape[1])
        out.append(np.argpartition(-both, some - 1, axis=1)[:, :some] + table * both.shape[1])
    return np.concatenate(out, axis=1).astype(np.int32)


def index(vectors: DataFrame, tables: int = TABLES, count: int = PROBES) -> tuple[DataFrame, int]:
    """(id, dim, v, codes) of every usable vector that is not zero, written once, and their number."""
    kept = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    kept = kept.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kept = kept.filter(length > 0)

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part["v"].flatten().to_numpy().reshape(-1, int(dim))
                found = nearest_axes(x, tables, count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part["id"], part["dim"], part["v"], lists], ["id", "dim", "v", "codes"])

    made = kept.mapInArrow(hashed, "id long, dim int, v array<double>, codes array<int>")
    made = materialize(made, "cross-polytope")
    return made, made.count()


def _bands(x: np.ndarray) -> np.ndarray:
    """Number of each row's band of lengths, from 0; rows of length 1 are in the middle of theirs."""
    number = np.floor(np.log(np.linalg.norm(x, axis=1)) / np.log(BAND) + 0.5)
    return np.unique(number, return_inverse=True)[1]


def often(dim: int, filed: int, tables: int) -> int:
    """Least number of shared buckets that at most a SHARE of rows of another direction have with a query.

    Of the signed axes a row is filed under ``filed`` in all and a query probes as many, so unlike ones share a Poisson number.
    """
    axes = 2 << max(1, (dim - 1).bit_length())
    mean = filed * (filed / tables) / axes
    chance, left, least = math.exp(-mean), 1.0, 0
    while left > SHARE:
        left -= chance
        least += 1
        chance *= mean / least
    return least


class Split:
    """The rows of one length that a task holds, and the buckets they are filed in."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, tables: int = TABLES):
        self.ids, self.x, self.band = ids, x, _bands(x)
        self.least = often(x.shape[1], codes.shape[1], tables)
        order = np.argsort(codes.ravel(), kind="stable")
        self.bucket, self.member = codes.ravel()[order], (order // codes.shape[1]).astype(np.int32)

    def met(self, probed: np.ndarray) -> np.ndarray:
        """How many of the probed buckets hold each row."""
        begin, end = np.searchsorted(self.bucket, probed, "left"), np.searchsorted(self.bucket, probed, "right")
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.member[at], minlength=len(self.ids))

    def candidates(self, probed: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows met often; in a band with fewer than POOL * ``k`` of them that many met most often, ties to the smaller id."""
        k = POOL * k
        met = self.met(probed)
        met[self.ids == own] = -1
        near = [np.flatnonzero(met >= self.least)]
        few = np.flatnonzero(np.bincount(self.band[near[0]], minlength=self.band.max() + 1) < k)
        for band in few:
            rows = np.flatnonzero((self.band == band) & (met >= 0) & (met < self.least))
            short = k - int((self.band[near[0]] == band).sum())
            if len(rows) > short and (met[rows] > 0).sum() >= short:
                rows = rows[np.lexsort((self.ids[rows], -met[rows]))[:short]]
            near.append(rows)
        return np.concatenate(near)


def _search(k: int, tables: int):
    """Best ``k`` of a split for each query of a batch, as ``against_all`` calls it."""
    held_last: list = [None, {}]

    def run(held: list[pa.RecordBatch], asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if held_last[0] is not held:
            held_last[0], held_last[1] = held, {}
            rows = pa.Table.from_batches(held).combine_chunks()
            dims = rows["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = rows.filter(pa.array(dims == dim))
                wide = lambda c: part[c].combine_chunks().flatten().to_numpy().reshape(len(part), -1)
                held_last[1][dim] = Split(part["id"].to_numpy(), wide("v"), wide("codes"), tables)
        out = []
        for query in asked.to_pylist():
            split = held_last[1].get(query["dim"])
            if split is None:
                continue
            near = split.candidates(np.array(query["codes"]), query["id"], k)
            score = split.x[near] @ np.array(query["v"])
            if len(near) > 4 * k:
                kth = np.partition(score, len(near) - k)[len(near) - k]
                near, score = near[score >= kth], score[score >= kth]
            first = np.lexsort((split.ids[near], -score))[:k]
            out.append((np.full(len(first), query["id"]), split.ids[near[first]], score[first]))
        if out:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int, tables: int = TABLES, count: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector where ``is_query``, the ``k`` of largest inner product found.

    ``is_query`` is a condition on id. Candidates have the query's number of components and another id. An id that comes
    with several vectors asks for one of them (the smallest), and every one of them is a candidate.
    """
    rows, n = index(vectors, tables, count)
    queries = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "v", "codes")).alias("q")).select("id", "q.dim", "q.v", "q.codes")
    schema = _parse_datatype_string("query_id long, vec_id long, score double")
    found = against_all(rows, queries, max(1, -(-n // SPLIT_ROWS)), _search(k, tables), schema)
    return best(found, k)


def op4(vectors: DataFrame) -> DataFrame:
    """Rows of the query: every 20th id against all rows, 20 each."""
    return nearest(vectors, "id % 20 = 0", 20)
