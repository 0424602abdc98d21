"""What a task holds at a time, and the rule scores are rounded by."""

import numpy as np
import pyarrow as pa

from quirewise.functions import ranking
from quirewise.functions.cosine import rounded
from quirewise.operators import entities, vectors


def test_halves_are_rounded_away_from_zero(spark):
    assert rounded(np.array([41 / 128, -41 / 128, 37 / 128, 0.1234564, 0.0])).tolist() == [0.320313, -0.320313, 0.289063, 0.123456, 0.0]
    stored = [(1, [41.0, 121.0, 7.0, 2.0, 3.0]), (2, [37.0, 122.0, 9.0, 5.0, 5.0])]
    stored = [(i, v + [float(np.sqrt(128**2 - np.dot(v, v)))]) for i, v in stored]
    asked = spark.createDataFrame([(0, [1.0] + [0.0] * 5)], "query_id int, vector array<double>")
    found = vectors.vector_topk(spark.createDataFrame(stored, "doc_id int, embedding array<double>"), asked)
    assert [(r["doc_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 0.320313), (2, 0.289063)]


class Passed:
    """Stands for a table and keeps the function that is to run in its tasks."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_entities_leave_a_task_slice_by_slice(spark, monkeypatch):
    held = Passed()
    monkeypatch.setattr(entities, "spread", lambda source: held)
    entities.extract_entities(spark.range(1).selectExpr("id as doc_id", "'x' as text"), doc_id="doc_id", content="text")
    texts = ["Ann Lee " * 50_000] * 10
    made = list(held.run(iter([pa.RecordBatch.from_pydict({"doc_id": range(10), "_text": texts})])))
    assert len(made) >= 4 and sum(b.num_rows for b in made) == sum(len(entities.pattern_finder()(t)) for t in texts)


def test_scores_are_summed_in_bounded_pieces(monkeypatch):
    rows = [{"query_id": q, "weights": [{"term": f"w{i}", "w": 1.0 + q} for i in range(8)]} for q in range(5)]
    block = ranking.QuestionBlock.of(rows, 6.0)
    entry = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    listed = pa.array([[{"term": f"w{j % 9}", "tf": 1 + j % 3} for j in range(i % 7)] for i in range(40)], entry)
    lengths = np.arange(40) + 1
    whole = ranking.keyword_scores(block, lengths, listed)
    sizes, plain = [], ranking.Listed._summed
    monkeypatch.setattr(ranking, "SLICE_ASKED", 60)
    monkeypatch.setattr(ranking.Listed, "_summed", lambda self, b: sizes.append(len(self.word)) or plain(self, b))
    assert np.array_equal(ranking.keyword_scores(block, lengths, listed), whole, equal_nan=True)
    assert len(sizes) > 5 and max(sizes) * 5 <= 75
    monkeypatch.setattr(ranking, "SLICE_WORDS", 10)
    batch = pa.RecordBatch.from_arrays([listed], ["postings"])
    parts = [p["postings"] for p in ranking._slices(batch, 5)]
    assert sum(map(len, parts)) == 40 and all(len(p) == 1 or len(p.flatten()) <= 10 for p in parts)
