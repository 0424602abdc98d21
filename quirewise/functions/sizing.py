"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 500_000
MAX_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Count rows and text bytes, stopping one row past the bound."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    width = sum(texts, F.lit(32 * len(df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_checked(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it fits, else unchanged: a shuffled, skew-split join."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that has no more splits than the cluster has cores.

    One small file is one or two busy tasks however many cores there are; costly row work on
    it is worth a shuffle. A large scan has many splits per core and is returned untouched, as
    is a plan with a shuffle of its own (it is adaptive, and counting its splits would run it).
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
