"""Key operators: look-ups, inserts that refuse known keys, deletes, bag difference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_checked


def equals_all(df: DataFrame, wanted: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(v) for k, v in wanted.items()])


def find_first(df: DataFrame, wanted: Mapping[str, Any], order_by: Sequence[str]) -> DataFrame:
    """First match of a compound key. The filter is pushed into the scan."""
    return df.filter(equals_all(df, wanted)).orderBy(*order_by).limit(1)


def find_many(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Batch look-up: every row whose key is listed in ``keys``."""
    return df.join(broadcast_checked(keys.select(*on)), list(on), "left_semi")


def owned_by(files: DataFrame, user_id: Any, column: str = "user_id") -> DataFrame:
    return files.filter(F.col(column) == F.lit(user_id))


def in_files(df: DataFrame, ids: DataFrame | Sequence[Any] | None, column: str) -> DataFrame:
    """Restrict a search to some files: a short list, a table of ids, or no restriction."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(broadcast_checked(ids.select(F.col(ids.columns[0]).alias(column))), column, "left_semi")
    return df.filter(F.col(column).isin(*ids))


def insert_if_absent(
    store: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The batch with an ``error`` column: NULL where the row may be appended.

    Refused are keys already stored and, within the batch, every row of a key but the first
    under ``order_by`` (which must identify a row). First rows come from a ``min`` aggregate,
    so a key repeated in a third of the batch is combined before the shuffle. What is known of
    a key is gathered in one row, and the batch joins it once, in a join that adaptive
    execution may broadcast or split.
    """
    order = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    firsts = incoming.groupBy(*keys).agg(F.min(order).alias("_first"), F.lit(True).alias("_keyed"))
    known = store.select(*keys).join(firsts.select(*keys), list(keys), "left_semi").distinct().withColumn("_known", F.lit(True))
    return (
        incoming.join(firsts.join(known, list(keys), "left"), list(keys), "left")
        .withColumn(
            "error",
            F.when(F.col("_keyed").isNull(), "missing key")
            .when(F.col("_known"), "key already stored")
            .when(~order.eqNullSafe(F.col("_first")), "key repeated in this batch"),
        )
        .select(*incoming.columns, "error")
    )


def delete_keys(store: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, keys that were not found)``."""
    wanted = keys.select(*on).distinct()
    kept = store.join(broadcast_checked(wanted), list(on), "left_anti")
    return kept, wanted.join(store.select(*on), list(on), "left_anti")


def delete_everywhere(
    stores: Mapping[str, tuple[DataFrame, str]], ids: DataFrame
) -> dict[str, DataFrame]:
    """Cascade: drop the listed document ids from every store ``name -> (table, id column)``."""
    wanted = broadcast_checked(ids.select(F.col(ids.columns[0]).alias("_id")))
    return {
        name: df.join(wanted, F.col(column) == F.col("_id"), "left_anti")
        for name, (df, column) in stores.items()
    }


def bag_difference(left: DataFrame, right: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Remove one occurrence from ``left`` per row of ``right``; absent rows are ignored.

    Copies are counted (partial aggregation, so a hot row costs one record per task) and written out where they
    are counted. Only a row with more than ``chunk`` copies left is cut into chunks that are spread over the cluster
    first: no task emits all copies of one row, and the others are not shuffled again.
    """
    cols = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.select(*cols).withColumn("_n", F.lit(-1)))
    left_over = signed.groupBy(*cols).agg(F.sum("_n").alias("_left")).filter("_left > 0")
    few = left_over.filter(F.col("_left") <= chunk).withColumnRenamed("_left", "_size")
    sizes = F.expr(f"transform(sequence(0L, (_left - 1) div {chunk}), i -> least({chunk}L, _left - i * {chunk}L))")
    many = left_over.filter(F.col("_left") > chunk).select(*cols, F.posexplode(sizes).alias("_piece", "_size"))
    many = many.repartition(*cols, "_piece").drop("_piece")
    return few.unionByName(many).select(*cols, F.explode(F.expr("sequence(1L, _size)")).alias("_copy")).drop("_copy")
