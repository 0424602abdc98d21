"""Toxicity and quality models: accuracy on the held-out fifth, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quirewise.llm import quality, toxicity
from quirewise.llm.texthash import hashed_words, shingle_sets
from quirewise.llm.training import held_out, training_rows

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "   \n"), (None, "text without id"), (4, "word " * 50_000), (4, "same id"), (5, "x" * 300_000)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_ranks_held_out_documents(spark, tables):
    docs, labels = tables
    rows = toxicity.op8(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    fresh = rows[rows.held_out]
    clean = fresh[fresh.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.02
    pairs = [(a > b) + 0.5 * (a == b) for a in fresh[fresh.toxic == 1].score for b in clean.score]
    assert np.mean(pairs) > 0.95
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_quality_separates_held_out_documents(spark, tables):
    docs, labels = tables
    rows = quality.op1(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").toPandas()
    fresh = rows[rows.held_out]
    assert fresh[fresh.quality == 1].selected.mean() > 0.98
    assert fresh[fresh.quality == 0].selected.mean() < 0.4


def test_held_out_rows_are_never_learned_from(spark):
    docs = spark.range(50).selectExpr("id doc_id", "concat('w', id) text")
    labels = spark.range(50).selectExpr("id doc_id", "1 toxic")
    rows = training_rows(docs, labels, "toxic", toxicity.features).count()
    kept = docs.filter(~held_out(docs.doc_id)).count()
    assert rows == kept < 50
    assert training_rows(docs, labels, "toxic", toxicity.features, max_rows=7).count() == 7


@pytest.mark.parametrize("rated", [[], [(1, 1)], [(1, 0), (2, 1), (3, 0), (None, 1), (4, None), (4, 1), (4, 0)]])
def test_odd_texts_and_labels(spark, rated):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as tail_prob", "2 as expected_grade")
    labels = spark.createDataFrame([(a, b, b) for a, b in rated], "doc_id long, quality int, toxic int")
    toxic = toxicity.op8(docs, labels).toPandas()
    good = quality.op1(docs, labels).toPandas()
    assert len(toxic) == len(good) == len(ODD)
    assert toxic.score.between(0, 1).all() and good.tail_prob.between(0, 1).all()
    kept = quality.rate_quality(docs, quality.fit_quality(docs, labels))
    assert sorted(kept.columns) == ["doc_id", "expected_grade", "score", "tail_prob", "text"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op8(docs, labels).count() == 0 == quality.op1(docs, labels).count()


def test_three_grades_are_ordered(spark):
    words = {0: "junk spam", 1: "plain words", 2: "fine prose"}
    rows = [(i, f"{words[i % 3]} number{i}", i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    rated = quality.rate_quality(docs, model).toPandas().set_index("doc_id").expected_grade
    means = [rated[[i for i in range(600) if i % 3 == g]].mean() for g in range(3)]
    assert means[0] < 0.4 and 0.6 < means[1] < 1.4 and means[2] > 1.6


def test_words_and_shingles_match_plain_python():
    texts = ["The  Cat\tsat\n", None, "", "a b c d e f", "x" * 3_000_000 + " tail", "A B c d É"]
    words, at = hashed_words(pa.array(texts))
    names = {}
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        plain = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        assert len(plain) == b - a
        for word, value in zip(plain, words[a:b], strict=True):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)
    sizes = [len(s) for s in shingle_sets(pa.array(["a b c d e a b c d e a b", "a b", "b a", ""]))]
    assert sizes == [5, 1, 1, 0]
