"""Approximate neighbours of vectors whose lengths differ."""

import numpy as np
import pytest

from quirewise.llm import crosspolytope

LENGTHS = {
    "one row x10": lambda random, n: np.where(np.arange(n) == 777, 10.0, 1.0),
    "uniform": lambda random, n: random.uniform(0.9, 1.1, n),
    "lognormal": lambda random, n: random.lognormal(0, 0.5, n),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_neighbours_of_vectors_of_other_lengths(spark, name):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    assert x.shape[1] == 64
    x *= LENGTHS[name](np.random.default_rng(1), len(x))[:, None]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = crosspolytope.op4(table.repartition(4)).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(got[ids[q]]) == 20
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-scores)[:20]])) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("dim", [64, 16])
def test_candidates_are_few_and_hold_the_neighbours(spark, dim):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(np.float64)[:, :dim], rows.vec_id.to_numpy()
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = crosspolytope.nearest_axes(x, crosspolytope.TABLES, crosspolytope.PROBES)
    split = crosspolytope.Split(ids, x, codes)
    shares, hits = [], []
    for q in np.flatnonzero(ids % 20 == 0):
        near = split.candidates(codes[q], ids[q], 20)
        scores = x @ x[q]
        scores[q] = -np.inf
        shares.append(len(near) / len(x))
        hits.append(np.isin(np.argsort(-scores)[:20], near).mean())
        assert len(np.unique(near)) == len(near) and q not in near
    assert np.mean(hits) >= 0.9 and np.mean(shares) <= (0.13 if dim == 64 else 0.25), (np.mean(hits), np.mean(shares))


def test_buckets_bring_together_what_shares_them():
    random = np.random.default_rng(4)
    x = random.normal(size=(300, 16))
    codes = crosspolytope.nearest_axes(x, 6, 2)
    split = crosspolytope.Split(np.arange(300), x, codes, 6)
    for q in range(0, 300, 37):
        assert split.met(codes[q]).tolist() == [len(set(codes[q]) & set(c)) for c in codes]
    few = crosspolytope.Split(np.arange(5), x[:5], codes[:5], 6)
    assert sorted(few.candidates(codes[0], 0, 20)) == [1, 2, 3, 4]
