"""What the fitted models find among documents they have not learned from."""

import pytest

from quirewise.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id"), labels


def test_toxic_documents_are_found(tables):
    docs, labels = tables
    rows = toxicity.op8(docs, labels).join(labels, "doc_id").toPandas()
    toxic = rows[rows.toxic == 1]
    assert toxic[toxic.held_out].predicted.mean() > 0.7
    assert toxic[~toxic.held_out].predicted.mean() > 0.98
    assert rows[rows.toxic == 0].predicted.mean() < 0.005


def test_bad_documents_are_rejected(tables):
    docs, labels = tables
    rows = quality.op1(docs, labels).join(labels, "doc_id").toPandas()
    fresh = rows[rows.held_out]
    assert fresh[fresh.quality == 0].selected.mean() < 0.08
    assert fresh[fresh.quality == 1].selected.mean() > 0.99
