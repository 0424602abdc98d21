"""Exact top-k by distributed histogram selection.

Every query is scored against every row, tile by tile. A tile counts its scores into 256 bins between the bounds known for
a query and passes on the highest bins only, up to the count still wanted: no lower score can be among the k. The
counts are added up over all tiles, the bin that holds the k-th value becomes the new bounds, and the round repeats
256 times finer until a bin is one value. Then one pass takes what reaches the k-th value, ties to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tiles import best, tiled, usable

STEP_BITS = 8


def _scores(queries: pd.DataFrame, rows: pd.DataFrame, exact: bool) -> np.ndarray:
    """Integer inner products, queries by rows."""
    kind = np.float64 if exact else np.int64
    q, x = (np.stack([np.asarray(v) for v in f["v"]]).astype(kind) for f in (queries, rows))
    return (q @ x.T).astype(np.int64)


def _counter(k: int, shift: int, width: int, exact: bool):
    def count(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            scores = _scores(queries, rows, exact)
            ids = rows["id"].to_numpy()
            for q, lo, above, s in zip(queries["id"], queries["lo"], queries["above"], scores, strict=True):
                s = s[(ids != q) & (s >= lo) & (s - lo < width)]
                bins, counts = np.unique((s - lo) >> shift, return_counts=True)
                enough = np.searchsorted(np.cumsum(counts[::-1]), k - above) + 1
                out.append((np.full(len(bins), q), bins, counts, enough))
        cut = [[x[-e:] for x in row[:3]] for *row, e in ((*o[:3], o[3]) for o in out)]
        cols = [np.concatenate(c) for c in zip(*cut, strict=True)] if cut else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("id", "bin", "n"), cols, strict=True)))

    return count


def _taker(k: int, exact: bool):
    def take(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            scores = _scores(queries, rows, exact)
            ids = rows["id"].to_numpy()
            for q, lo, s in zip(queries["id"], queries["lo"], scores, strict=True):
                at = np.flatnonzero((ids != q) & (s >= lo))
                at = at[np.lexsort((ids[at], -s[at]))[:k]]
                out.append((np.full(len(at), q), ids[at], s[at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return take


def quantised(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(id, dim, v) with v = floor(factor * x) for each component; unusable vectors and null ids take no part."""
    kept = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return kept.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), whole.alias("v"))


def exact_topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, all if fewer.

    Both tables are (id, dim, v). Only rows of a query's own length are its candidates, and none of its own id. A query
    id that comes with several vectors is answered for one of them (the smallest).
    """
    queries = queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n_rows, top = rows.agg(F.count("*"), F.max(norm)).first()
    n_queries, high = queries.agg(F.count("*"), F.max(norm)).first()
    bound = (math.isqrt(int((top or 0) * 1.000001)) + 2) * (math.isqrt(int((high or 0) * 1.000001)) + 2)  # Cauchy-Schwarz
    if bound >= 1 << 62:
        raise ValueError("scores of these vectors do not fit 64-bit integers")
    exact = bound < 1 << 52  # then double-precision products are exact integers
    bits = (2 * bound + 1).bit_length()
    state = queries.select("id", F.lit(-bound).cast("long").alias("lo"), F.lit(0).cast("long").alias("above"))
    while bits > 0:
        shift = max(0, bits - STEP_BITS)
        counts = tiled(rows, queries.join(state, "id"), n_rows, n_queries, _counter(k, shift, 1 << bits, exact), "id long, bin long, n long")
        summed = counts.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        reached = summed.withColumn("upto", F.sum("n").over(down)).join(state, "id").filter(F.col("upto") + F.col("above") >= k)
        found = reached.groupBy("id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"))).alias("hit"))
        state = materialize(
            state.join(found.select("id", F.col("hit.bin").alias("bin"), F.col("hit.over").alias("over")), "id", "left").select(
                "id", (F.col("lo") + F.coalesce("bin", F.lit(0)) * (1 << shift)).alias("lo"),
                (F.col("above") + F.coalesce("over", F.lit(0))).alias("above"),
            ),
            "kth-values",
        )
        bits = shift
    found = tiled(rows, queries.join(state, "id"), n_rows, n_queries, _taker(k, exact), "query_id long, vec_id long, score long")
    return best(found, k)


def op6(vectors: DataFrame) -> DataFrame:
    """Rows of the query: every 50th id against all rows, 5 each."""
    rows = quantised(vectors)
    return exact_topk(rows, rows.filter("id % 50 = 0"), 5)
