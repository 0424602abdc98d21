"""Fitting hashed-text models on a bounded sample of labelled rows, in shards that are averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .batches import pieces

#: Documented bound of a training sample: this many labelled rows, chosen by a hash of doc_id.
MAX_ROWS = 16_384
#: Shards of the sample, each fitted by a task of its own and then averaged.
SHARDS = 4


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learned from (crc32 of the id as text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, features: Callable[[pa.Array], list[np.ndarray]],
    max_rows: int = MAX_ROWS, shards: int = SHARDS,
) -> DataFrame:
    """Rows (shard, place, label, features) of at most ``max_rows`` labelled documents outside the held-out fifth.

    ``features`` gives the sorted distinct feature numbers of each text. Rows without an id or a label
    are not learned from; a document labelled twice is learned from twice.
    """
    bound_batches(docs.sparkSession)
    sample = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", "label", F.xxhash64("doc_id").alias("place"))
        .orderBy("place", "doc_id", "label")
        .limit(max_rows)
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch):
                found = pa.array([x.astype(np.int32).tobytes() for x in features(part["text"])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part["shard"], part["place"], part["label"], found], ["shard", "place", "label", "features"]
                )

    joined = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most max_rows rows of three numbers
        .select((F.pmod("place", F.lit(shards))).cast("int").alias("shard"), "place", "label", "text")
    )
    return joined.mapInArrow(batches, "shard int, place long, label int, features binary")


def fit(
    rows: DataFrame, fit_shard: Callable[[list[tuple[int, np.ndarray]], np.ndarray], np.ndarray], state: np.ndarray
) -> np.ndarray:
    """Run ``fit_shard(examples, state)`` on every shard in a task of its own and average the fitted states.

    A state is one float32 array of fixed size, so what reaches the driver is bounded by the shards times it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def one(table: pa.Table) -> pa.Table:
        place, label, found = table["place"].to_numpy(), table["label"].to_numpy(), table["features"]
        # the examples are views of the table, which holds all features of the shard once
        examples = [(int(label[i]), np.frombuffer(found[int(i)].as_buffer(), np.int32)) for i in np.lexsort((label, place))]
        fitted = fit_shard(examples, shared.value.copy())
        return pa.table({"rows": pa.array([len(table)], pa.int64()), "state": pa.array([fitted.astype(np.float32).tobytes()], pa.binary())})

    fitted = rows.groupBy("shard").applyInArrow(one, "rows long, state binary").collect()
    shared.unpersist()
    if not fitted:
        return state
    total = sum(r["rows"] for r in fitted)
    return sum(np.frombuffer(r["state"], np.float32).astype(np.float64) * (r["rows"] / total) for r in fitted).astype(np.float32)
