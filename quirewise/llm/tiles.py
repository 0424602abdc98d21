"""All queries of a table of vectors against all rows, in tiles of bounded size.

Rows are dealt into splits and queries into blocks by a hash of their id; a tile is one split against one block.
Both sides of a tile are bounded, so neither memory nor what a task sends depends on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_ROWS, BLOCK_QUERIES = 8192, 1024


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null and no non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def tiled(
    rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, compare: Callable, schema: str
) -> DataFrame:
    """``compare(queries, rows)``, two pandas frames, for every tile; both sides have id and dim."""
    splits, blocks = max(1, -(-n_rows // SPLIT_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # may come from the same scan as the rows
    left = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("split", each(splits))
    right = rows.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")).withColumn("block", each(blocks))
    keys = ["dim", "split", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
