import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirewise.errors import RequestError
from quirewise.operators import vector_index, vectors
from quirewise.operators.vector_index import build_index, decode, encode, open_index, rejected_vectors, search_index

SCHEMA = "doc_id long, embedding array<float>, lang string"


def table(spark, n, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(v) for v in row], "de" if i % 3 else "en") for i, row in enumerate(x)], SCHEMA)


def asked(df, every):
    return df.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "embedding").withColumnRenamed("embedding", "vector")


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = table(spark, 1500)
    path = str(tmp_path_factory.mktemp("index"))
    return df, build_index(df, path, keep=["lang"]), path


def test_recall_over_all_queries_and_exact_scores(spark, index):
    df, made, path = index
    queries = asked(df, 1)
    exact = answers(vectors.vector_topk(df.select("doc_id", "embedding"), queries))
    found = answers(search_index(open_index(spark, path), queries))
    hits = sum(len({d for _, d, _ in found[q]} & {d for _, d, _ in rows}) for q, rows in exact.items())
    assert hits >= 0.9 * sum(map(len, exact.values()))
    scores = {(q, d): s for q, rows in exact.items() for _, d, s in rows}
    assert all(abs(scores[q, d] - s) < 2e-6 for q, rows in found.items() for _, d, s in rows if (q, d) in scores)
    whole = answers(search_index(made, asked(df, 30), probes=len(made.centres), pool=1500))
    assert {q: [d for _, d, _ in rows] for q, rows in whole.items()} == {q: [d for _, d, _ in exact[q]] for q in whole}


def test_a_search_opens_few_bytes(spark, index, tmp_path):
    df, made, path = index
    query = asked(df, 1).filter("query_id = 7").collect()[0]
    unit = np.array([query["vector"]]) / np.linalg.norm(query["vector"])
    probes = round(len(made.centres) * vector_index.PROBED)
    opened = set(vector_index._cells_of(unit, made.centres, probes)[0].tolist())
    read = whole = 0
    import glob

    for file in glob.glob(f"{path}/rows/cell=*/*.parquet"):
        cell = int(file.split("cell=")[1].split("/")[0])
        group = pq.ParquetFile(file).metadata.row_group(0)
        for i in range(group.num_columns):
            column = group.column(i)
            whole += column.total_uncompressed_size
            if cell in opened and column.path_in_schema.split(".")[0] in ("doc_id", "code"):
                read += column.total_uncompressed_size
    assert 0 < read <= 0.25 * whole
    scanned = made.rows.filter(F.col("cell").isin(sorted(opened))).select("doc_id", "cell", "code")
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_conditions_come_before_ranking(index):
    df, made, _ = index
    found = search_index(made, asked(df, 50), where="lang = 'en'", probes=len(made.centres))
    assert all(r["doc_id"] % 3 == 0 for r in found.collect()) and found.count() == 10 * 30


def test_many_queries_stream_past_the_rows(spark, index, monkeypatch):
    df, made, _ = index
    queries = asked(df, 25)
    few = answers(search_index(made, queries))
    exact = answers(vectors.vector_topk(df, queries))
    monkeypatch.setattr(vector_index, "MAX_BLOCK_QUERIES", 7)
    monkeypatch.setattr(vector_index, "SPLIT_ROWS", 400)
    monkeypatch.setattr(vectors, "MAX_BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "SPLIT_ROWS", 400)
    assert answers(search_index(made, queries)) == few
    assert answers(vectors.vector_topk(df, queries)) == exact


def test_new_rows_are_found_and_odd_ones_refused(spark, index, tmp_path):
    df, _, _ = index
    made = build_index(df.filter("doc_id < 1000"), str(tmp_path / "grown"), keep=["lang"])
    vector_index.add_vectors(made, df.filter("doc_id >= 1000"), keep=["lang"])
    queries = asked(df, 100)
    found = answers(search_index(made, queries, probes=len(made.centres)))
    assert all(rows[0][1] == q and rows[0][2] == 1.0 for q, rows in found.items())
    odd = [(1, [1.0] * 16), (2, None), (3, []), (4, [0.0] * 16), (5, [1.0] * 3), (6, [math.nan] * 16), (7, [math.inf] * 16)]
    rows = spark.createDataFrame(odd, "doc_id long, embedding array<float>")
    reasons = {r["doc_id"]: r["reason"] for r in rejected_vectors(rows, 16).collect()}
    assert set(reasons) == {2, 3, 4, 5, 6, 7} and reasons[5] == "has 3 numbers, not 16"
    kept = build_index(rows, str(tmp_path / "odd"))
    assert [r["doc_id"] for r in kept.rows.collect()] == [1]
    best = vectors.vector_topk(rows, spark.createDataFrame([(1, [1.0] * 16)], "query_id int, vector array<double>"))
    assert 1 in {r["doc_id"] for r in best.collect()} and 5 not in {r["doc_id"] for r in best.collect()}
    with pytest.raises(RequestError):
        search_index(kept, spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>"))
    with pytest.raises(RequestError):
        build_index(rows.filter("doc_id = 2"), str(tmp_path / "none"))


def test_codes_are_close_to_the_numbers():
    rng = random.Random(2)
    for dim in (1, 7, 64):
        x = np.array([[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(20)])
        codes = encode(x, 1.0)
        assert codes.shape == (20, -(-dim // 2)) and np.abs(decode(codes, dim, 1.0) - x).max() <= 1 / 16 + 1e-9
