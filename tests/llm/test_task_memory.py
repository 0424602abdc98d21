"""What a task and its Python worker hold at a time does not follow the length of the texts."""

import numpy as np
import pyarrow as pa

from quirewise.llm import jaccard
from quirewise.llm.batches import add_columns
from quirewise.llm.training import fit
from quirewise.session import BATCH_BYTES, BATCH_CONF, bound_batches


def test_texts_pass_in_bounded_batches(spark):
    session = spark.newSession()
    docs = session.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 1200) as text")
    held = add_columns(docs, "held long", lambda part: [pa.array([part.get_total_buffer_size()] * len(part), pa.int64())])
    assert held.agg({"held": "max"}).first()[0] < 2 * BATCH_BYTES  # all texts hold 12 MB


def test_own_bound_of_a_session_stays(spark):
    session = spark.newSession()
    session.conf.set(BATCH_CONF, "1m")
    bound_batches(session)
    assert session.conf.get(BATCH_CONF) == "1m"


def test_prefix_blocks_are_passed_on_early():
    texts = [" ".join(f"w{i}x{j}" for j in range(5000)) for i in range(600)]  # about 1,000 entries of each
    order = type("Order", (), {"value": np.zeros(1 << jaccard.COUNT_BITS, np.int64)})
    made = [len(b"".join(x["keys"].to_pylist())) // 8 for x in jaccard._prefixes(order, 8)(iter([pa.record_batch({"text": texts})]))]
    assert sum(made) == 600 * (4996 - 3997 + 1)
    assert max(made) <= 300_000


def test_a_shard_is_fitted_in_order_of_place_and_label(spark):
    rows = [(0, place, label, np.arange(place % 3, dtype=np.int32).tobytes()) for place, label in [(5, 1), (-2, 0), (5, 0), (9, 1), (0, 0)]]
    rows = spark.createDataFrame(rows, "shard int, place long, label int, features binary")
    state = fit(rows.coalesce(1), lambda examples, state: np.array([10 * label + len(x) for label, x in examples], np.float32), np.zeros(1, np.float32))
    assert state.tolist() == [1, 0, 2, 12, 10]
