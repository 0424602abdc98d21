"""Table operators: filter, count, distinct, de-duplicate, project, render, export."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConditionError, RequestError
from ..functions.predicates import Condition, compile_conditions, text_predicate, typed_predicate
from ..functions.text import norm


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key group under ``order``.

    ``row_number() = 1`` is planned with a group limit *before* the shuffle, so each task
    sends at most one row per key: a key holding a third of the table stays cheap.
    """
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, subset: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return keep_one(df, subset, [F.col(n).asc() for n in names])


def keep_latest(df: DataFrame, keys: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """Last write wins per key."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return keep_one(df, keys, [F.col(n).desc() for n in names])


def drop_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, order_by: str | Sequence[str] | None = None
) -> DataFrame:
    """All-column duplicates, or keep-first on ``subset``.

    A Spark table has no row order, so keep-first needs to be told one.
    """
    if not subset:
        return df.dropDuplicates()
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise RequestError(f"The table lacks these columns: {missing}")
    if order_by is None:
        raise RequestError("De-duplicating on a subset keeps the first row: name an order column.")
    return keep_first(df, subset, order_by)


def normalize_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    present = [n for n in names if n in df.columns]
    return df.withColumns({n: norm(F.col(f"`{n}`")) for n in present}) if present else df


def filter_table(
    df: DataFrame,
    conditions: Condition | list[Condition] | None,
    *,
    text_mode: bool,
    dedup: bool = False,
    subset: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    normalize: Sequence[str] = ("Gender",),
    count_only: bool = False,
    literal: bool = False,
) -> DataFrame:
    """The structured query: normalise, filter, de-duplicate, then project or count."""
    if isinstance(conditions, dict) and conditions.get("count_only"):
        count_only = True
    if text_mode:
        df = normalize_columns(df, normalize)
    rows = df.filter(compile_conditions(df, conditions, text_mode, literal))
    if dedup and count_only:  # which row is kept does not matter to a count
        rows, dedup = rows.select(*[F.col(f"`{c}`") for c in subset or rows.columns]).distinct(), False
    if dedup:
        rows = drop_duplicates(rows, subset, order_by)
    if count_only:
        return rows.agg(F.count(F.lit(1)).alias("Count"))
    if columns:
        missing = [c for c in columns if c not in rows.columns]
        if missing:
            raise RequestError(f"The table lacks these columns: {missing}")
        rows = rows.select(*[F.col(f"`{c}`") for c in columns])
    return rows


def count_matching(df: DataFrame, column: str, value: Any, text_mode: bool) -> DataFrame:
    """Rows whose cell equals ``value``; text columns compare case-insensitively."""
    if column not in df.columns:
        raise ConditionError(f"The table has no column {column!r}.")
    if text_mode or isinstance(df.schema[column].dataType, T.StringType):
        test = text_predicate(column, "==", value)
    else:
        test = typed_predicate(df, column, "==", value)
    return df.agg(F.count_if(test).alias("Count"))


def distinct_values(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Distinct values in order of first appearance; NULL is a value."""
    if column not in df.columns:
        raise RequestError(f"The table has no column {column!r}, only {df.columns}")
    return (
        df.groupBy(F.col(f"`{column}`").alias("value"))
        .agg(F.min(order_by).alias("first_seen"))
        .orderBy("first_seen")
    )


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys used more than once, with their number of uses."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def column_widths(df: DataFrame) -> DataFrame:
    """Export width per column: the longest of header and cells, plus two. One pass."""
    widths = [
        (F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))) + 2).alias(c)
        for c in df.columns
    ]
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("width")) for c in df.columns]
    return df.agg(*widths).select(F.inline(F.array(*pairs)))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One searchable line per table row; missing cells read ``NaN``."""
    names = list(columns or df.columns)
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN")) for c in names])


def table_to_text(
    df: DataFrame, row_no: str, columns: Sequence[str] | None = None, by: Sequence[str] = (), block_rows: int = 1000
) -> DataFrame:
    """Table text in blocks of ``block_rows`` consecutive rows, lines in row order.

    The blocks of one table joined by a line break, in ``block_no`` order, are its whole
    text. A block is bounded, so no table, however long, has to fit into one row or task.
    """
    block = F.floor(F.col(row_no) / F.lit(block_rows)).cast("bigint")
    return (
        df.select(*by, block.alias("block_no"), F.col(row_no).alias("_row"), row_text(df, columns).alias("_line"))
        .groupBy(*by, "block_no")
        .agg(F.expr("listagg(_line, '\\n') within group (order by _row)").alias("text"))
    )


def result_as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))

