"""Exact top-k and approximate neighbours against full scoring, the pipeline stage by stage, and the oracles."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quirewise.llm import crosspolytope, plans, tiles, topk  # noqa: F401  (plans registers the queries)
from quirewise.plans.registry import ORACLES, QUERIES
from quirewise.session import materialize

NAN, INF = float("nan"), float("inf")
BROKEN = [(1000, None), (1050, [NAN] * 8), (1100, [INF] + [0.0] * 7), (1150, [None] + [0.0] * 7), (None, [1.0] * 8), (1200, [1.0, 2.0]), (1250, [0.5, 0.5])]


def vectors(spark, n=700, seed=3, scale=False):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 8)).astype(np.float32)
    x[100:350] = x[100]  # a third are one vector
    if scale:
        x *= random.uniform(0.2, 3, (n, 1)).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame(rows + BROKEN, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as dim")
    return x, table.repartition(5)


@pytest.mark.parametrize("split", [8192, 64])
def test_topk_matches_full_scoring(spark, monkeypatch, split):
    monkeypatch.setattr(tiles, "SPLIT_ROWS", split)
    monkeypatch.setattr(tiles, "BLOCK_QUERIES", 5)
    x, table = vectors(spark)
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    expected = {(1200, 1, 1250, 640 * 0 + 256 * 128 + 512 * 128), (1250, 1, 1200, 256 * 128 + 512 * 128)}
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:5]
        expected |= {(q, r + 1, i, scores[i]) for r, i in enumerate(order)}
    assert {tuple(r) for r in topk.op6(table).collect()} == expected
    assert topk.op6(table.limit(0)).count() == 0


def test_topk_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (50, [-2.0]), (50, [-2.0]), (7, [0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.op6(table).collect())
    assert got == [(0, 1, 7, 0), (0, 2, 50, -131072), (0, 3, 50, -131072), (50, 1, 7, 0), (50, 2, 0, -131072)]


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_reach_the_recall(spark, monkeypatch, scale):
    monkeypatch.setattr(tiles, "SPLIT_ROWS", 100)
    x, table = vectors(spark, scale=scale)
    x = x.astype(np.float64)
    got = {}
    for r in crosspolytope.op4(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in range(0, 700, 20):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -scores.round(9))) if i != q][:20]
        found = [got[q][k] for k in sorted(got[q])]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(scores[i] - s) < 1e-9 and i != q for i, s in found)
        kth = scores[order[-1]] - 1e-9
        hit, total = hit + sum(s >= kth for _, s in found), total + len(order)
    assert hit / total >= 0.9
    assert 1000 not in got and crosspolytope.op4(table.limit(0)).count() == 0


def test_neighbours_reach_the_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    x, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    got = crosspolytope.op4(table).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -9
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-scores)[:20]])) / 20)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("extra", F.concat("lang", F.lit("x")))
    odd = spark.createDataFrame([(-1, None, None, None, None, "x"), (-2, "", "en", "s", 0, "y")], docs.schema)
    docs = materialize(docs.unionByName(odd), "odd-documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, folder), "stage")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert docs.filter("n_chars != length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_runs(spark):
    assert set(corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns) >= {"doc_id", "piece", "sequence_id", "offset"}


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op6_exact_topk", "op9_chat_format"])
def test_oracle(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    expected = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, folder).toPandas()[list(expected.columns)]
    keys = list(expected.columns)
    assert got.sort_values(keys).astype(str).values.tolist() == expected.sort_values(keys).astype(str).values.tolist()
