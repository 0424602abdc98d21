"""Running totals along an integer order that survive one key owning most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096


def total_before(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, segment: int = SEGMENT
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the same key's rows with a smaller ``order``.

    A plain window would sort a whole key in one task. Here each key is cut into segments of
    ``segment`` order numbers: a window runs inside segments, one aggregate gives a number per
    segment, and only those few numbers are summed along the key.
    """
    cut = df.withColumns({"_segment": F.floor(F.col(order) / segment).cast("bigint"), "_value": value})
    totals = cut.groupBy(*keys, "_segment").agg(F.sum("_value").alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_segment", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return local.join(starts, [*keys, "_segment"]).select(
        *df.columns, (F.col("_start") + F.col("_inside")).alias(name)
    )
