"""A vector index at rest: an inverted file of cells, with a short code beside every vector.

``build_index`` writes two tables under one folder:

- ``cells``: the centre of every cell, and the scale of the codes;
- ``rows``: doc_id, code, embedding, and what else is kept, partitioned by cell and sorted by doc_id.

A code holds four bits for each number of the vector, an eighth of its bytes. A search opens only the cells whose centres
are nearest to a query and reads only their codes; of the best ``pool`` by code the vectors are fetched and scored
exactly. So the files of other cells are never opened, and the column of vectors is read for a few rows.

Centres and scale are fitted on a bounded sample (SAMPLE_NUMBERS numbers: 65,536 vectors of 64): the rows of lowest md5 of their id
are the first centres, and each centre then moves once to the mean of its rows. Every row is indexed. Similarity is the
cosine; rows without a direction (null, empty, zero, or of other than finite numbers) or of another length are
not indexed and come back from ``rejected_vectors``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import RequestError
from ..functions.cosine import RunningTop, rounded, to_matrix, unit_rows
from ..functions.streams import SPLIT_ROWS, against_all
from ..session import materialize
from .keyword import top_k

#: Numbers of the sample that centres and scale are fitted on, and the bounds of the number of cells.
SAMPLE_NUMBERS, LEAST_CELLS, MOST_CELLS = 1 << 22, 4, 4096
#: Rows of a cell that go into one file, about.
FILE_ROWS = 1_000_000
#: Share of the cells that a query probes, and candidates by code for each row of the answer.
PROBED, POOL = 0.75, 4
LEVELS = 16
MAX_BLOCK_QUERIES = 4096
#: Candidate ids up to which the fetch of vectors is also narrowed by id.
MAX_PUSHED_IDS = 10_000


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray  # unit length, one row per cell
    scale: float

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def _has_direction(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rejected_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(doc_id, reason)`` of the rows that an index or a search of vectors of ``dim`` numbers leaves out."""
    size = F.size("embedding")
    reason = (
        F.when(F.col("embedding").isNull() | (size <= 0), "no vector")
        .when(size != dim, F.concat(F.lit("has "), size.cast("string"), F.lit(f" numbers, not {dim}")))
        .when(~_has_direction(F.col("embedding")), "no direction")
    )
    return vectors.select("doc_id", reason.alias("reason")).filter("reason is not null")


def _cells_of(unit: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` nearest cells of each row, nearest first, ties to the smaller number."""
    near = rounded(unit @ centres.T)
    return np.argsort(-near, axis=1, kind="stable")[:, :count]


def _fit(sample: np.ndarray, cells: int) -> tuple[np.ndarray, float]:
    """Centres and scale from the sample, whose first rows are the first centres."""
    unit = unit_rows(sample)
    centres = unit[:cells]
    owner = _cells_of(unit, centres)[:, 0]
    moved = np.zeros_like(centres)
    np.add.at(moved, owner, unit)
    return rounded(unit_rows(moved)), float(np.abs(unit).max())


def encode(unit: np.ndarray, scale: float) -> np.ndarray:
    """Two numbers a byte, the first in the low half."""
    levels = np.clip(np.floor((unit / scale + 1) * (LEVELS // 2)), 0, LEVELS - 1).astype(np.uint8)
    if levels.shape[1] % 2:
        levels = np.concatenate([levels, np.zeros((len(levels), 1), np.uint8)], axis=1)
    return levels[:, ::2] | (levels[:, 1::2] << 4)


def decode(codes: np.ndarray, dim: int, scale: float) -> np.ndarray:
    levels = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, :dim]
    return ((levels + 0.5) / (LEVELS // 2) - 1) * scale


def build_index(vectors: DataFrame, path: str, cells: int | None = None, keep: Sequence[str] = ()) -> VectorIndex:
    """Index ``vectors`` (doc_id, embedding, ...) under ``path``; ``keep`` columns can be filtered on in a search.

    The length of the vectors is the most frequent one, ties to the longer. Without ``cells`` there is one for the square root of the rows.
    """
    spark = vectors.sparkSession
    given = vectors.filter(_has_direction(F.col("embedding")))
    lengths = given.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        raise RequestError("No vector to index.")
    dim, n = most
    cells = min(MOST_CELLS, max(LEAST_CELLS, int(n**0.5))) if cells is None else cells
    sample = given.filter(F.size("embedding") == dim).select("doc_id", "embedding")
    sample = sample.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max(cells, SAMPLE_NUMBERS // dim))
    centres, scale = _fit(np.array([r["embedding"] for r in sample.collect()], np.float64), cells)
    table = spark.createDataFrame([(i, c.tolist(), scale) for i, c in enumerate(centres)], "cell int, centre array<double>, scale double")
    table.coalesce(1).write.parquet(f"{path}/cells")
    index = VectorIndex(spark, path, centres, scale)
    add_vectors(index, vectors, keep)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    return VectorIndex(spark, path, np.array([r["centre"] for r in rows]), rows[0]["scale"])


def add_vectors(index: VectorIndex, vectors: DataFrame, keep: Sequence[str] = ()) -> None:
    """Append rows to the index; their ids must be new to it. A large cell is spread over several files by id."""
    dim, context = index.centres.shape[1], vectors.sparkSession.sparkContext
    source = vectors.filter(_has_direction(F.col("embedding")) & (F.size("embedding") == dim)).select("doc_id", "embedding", *keep)
    shared, scale = context.broadcast(index.centres), index.scale
    schema = T.StructType([*source.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = unit_rows(to_matrix(part["embedding"], dim))
                codes = encode(unit, scale)
                made = pa.array([c.tobytes() for c in codes], pa.binary())
                cell = pa.array(_cells_of(unit, shared.value)[:, 0], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, made, cell], [*batch.schema.names, "code", "cell"])

    placed = materialize(source.mapInArrow(assign, schema), "indexed-vectors")
    held = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))  # MOST_CELLS rows at most
    dealt = placed.join(F.broadcast(held), "cell").withColumn("_file", F.pmod(F.xxhash64("doc_id"), F.col("_files")))
    dealt.repartition("cell", "_file").sortWithinPartitions("cell", "_file", "doc_id").drop("_files", "_file").write.partitionBy(
        "cell"
    ).mode("append").parquet(f"{index.path}/rows")


def search_index(
    index: VectorIndex, queries: DataFrame, k: int = 10, *, probes: int | None = None, pool: int | None = None, where: Column | str | None = None
) -> DataFrame:
    """About the best ``k`` vectors per query by cosine: ``(query_id, doc_id, score, rank)``; scores are exact.

    ``queries``: ``query_id, vector``; one id should come once. ``where`` is a condition on kept columns, applied before ranking.
    """
    cells, dim = index.centres.shape
    probes = max(1, round(cells * PROBED)) if probes is None else min(probes, cells)
    pool = POOL * k if pool is None else max(pool, k)
    asked = queries.filter(_has_direction(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    centres, scale, rows = index.spark.sparkContext.broadcast(index.centres), index.scale, index.rows
    schema = T.StructType([queries.schema["query_id"], *asked.schema.fields[1:], T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _cells_of(unit_rows(to_matrix(batch["vector"], dim)), centres.value, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probes), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["query_id", "vector", "cells"])

    if not asked.filter(F.size("vector") != dim).isEmpty():
        raise RequestError(f"The index holds vectors of {dim} numbers.")
    asked = materialize(asked.mapInArrow(probe, schema), "probing-queries")
    opened = [r[0] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # MOST_CELLS at most
    scanned = rows.filter(F.col("cell").isin(opened))
    scanned = scanned.filter(where) if where is not None else scanned
    found_schema = T.StructType(
        [asked.schema["query_id"], rows.schema["doc_id"], T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )

    def score(held: Iterator[pa.RecordBatch], block: list[dict]) -> Iterator[pa.RecordBatch]:
        unit = unit_rows(np.array([q["vector"] for q in block], np.float64))
        of_cell: dict[int, list[int]] = {}
        for i, q in enumerate(block):
            for cell in q["cells"]:
                of_cell.setdefault(cell, []).append(i)
        best, place = RunningTop(len(block), pool), {}
        for batch in held:
            cell, ids = batch["cell"].to_numpy(), batch["doc_id"].to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            for number in np.unique(cell).tolist():
                some, wanted = np.flatnonzero(cell == number), of_cell.get(number, [])
                if wanted:
                    near = rounded(decode(codes[some], dim, scale) @ unit[wanted].T)
                    for column, q in enumerate(wanted):
                        best.offer(q, near[:, column], ids[some])
                    place.update((i, number) for q in wanted for i in best.ids[q].tolist() if i not in place)
        found = [(block[q]["query_id"], i, place[i], s) for q in range(len(block)) if best.ids[q] is not None
                 for i, s in zip(best.ids[q].tolist(), best.scores[q].tolist(), strict=True)]
        if found:
            columns = [list(c) for c in zip(*found, strict=True)]
            kinds = [q_type, id_type, pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "doc_id", "cell", "score"])

    q_type, id_type = (to_arrow_type(found_schema[c].dataType) for c in ("query_id", "doc_id"))
    count, codes = asked.count(), scanned.select("doc_id", "cell", "code")
    if count <= MAX_BLOCK_QUERIES:
        block = index.spark.sparkContext.broadcast([r.asDict() for r in asked.collect()])
        near = codes.mapInArrow(lambda batches: score(batches, block.value), found_schema)
    else:
        def stream(held: list[pa.RecordBatch], some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, some.num_rows, MAX_BLOCK_QUERIES):
                yield from score(iter(held), some.slice(at, MAX_BLOCK_QUERIES).to_pylist())

        near = against_all(codes, asked, max(1, -(-codes.count() // SPLIT_ROWS)), stream, found_schema)
    pooled = top_k(near, pool).select("query_id", "doc_id", "cell")
    pooled = materialize(pooled, "candidates")
    fetched = rows.filter(F.col("cell").isin(opened))
    ids = [r[0] for r in pooled.select("doc_id").distinct().limit(MAX_PUSHED_IDS + 1).collect()]
    if len(ids) <= MAX_PUSHED_IDS:  # narrows what is read; the join decides
        fetched = fetched.filter(F.col("doc_id").isin(ids))
    fetched = fetched.select("cell", "doc_id", "embedding")
    met = pooled.join(fetched, ["cell", "doc_id"]).join(asked.select("query_id", "vector"), "query_id")
    return top_k(met.select("query_id", "doc_id", _cosine("vector", "embedding").alias("score")), k).select("query_id", "doc_id", "score", "rank")


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)
