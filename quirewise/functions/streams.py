"""Batches in bounded slices, and all rows of one table against all rows of another inside tasks, when neither fits one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task holds at a time while the other table streams past.
SPLIT_ROWS = 16_384


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    pa.default_memory_pool().release_unused()  # a worker goes on to other tasks; Arrow would keep what the largest one took
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    offsets = np.append(0, np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def against_all(
    rows: DataFrame, queries: DataFrame, splits: int, kernel: Callable[[list[pa.RecordBatch], pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """What ``kernel(held, asked)`` gives for each split of ``rows`` and each batch of ``queries``.

    ``rows`` should be written rows; they are dealt into ``splits`` and shuffled once. Queries are copied to every split and
    sorted behind its rows, so a task holds one split while all queries stream past it in batches: its memory depends on
    neither table's size, and nothing passes the driver.
    """
    of_row = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    of_query = T.StructType([T.StructField(f.name, f.dataType) for f in queries.schema.fields])
    left = rows.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(splits)).alias("split"), F.lit(0).alias("side"),
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.lit(None).cast(of_query).alias("query"),
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("split"), F.lit(1).alias("side"),
        F.lit(None).cast(of_row).alias("row"), F.struct(*(F.col(f"`{c}`") for c in queries.columns)).alias("query"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            split, side = batch["split"].to_numpy(), batch["side"].to_numpy()
            edges = np.flatnonzero((split[1:] != split[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(split)], strict=True):
                if split[a] != current:
                    current, held = split[a], []
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(pa.RecordBatch.from_struct_array(part["row"]))
                elif held:
                    yield from kernel(held, pa.RecordBatch.from_struct_array(part["query"]))

    both = left.unionByName(right).repartition(splits, "split").sortWithinPartitions("split", "side")
    return both.mapInArrow(run, schema)
