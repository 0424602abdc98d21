"""MinHash near-duplicates: distinct five-word shingles, Jaccard similarity of 0.85 or more, confirmed on the full sets.

1. Texts with equal shingle sets fold into one class, named by a fingerprint of the set. Its signature holds the smallest
   value of each of MINIMA universal hash functions, (a * shingle + b) mod 2**64 with a odd, upper half.
2. Banding. Of ROWS neighbouring minima each band makes a key; classes with a key in common share a bucket. Two sets of
   similarity s agree in a band with probability s ** ROWS, so at 0.85 all 32 bands miss a pair once in 2e10.
   Buckets with the same members are one.
3. Signature verification. Of two linked sets' minima fewer than AGREE are equal once in a billion pairs. Pairs above that
   are decided by the exact intersection of the full sets (``linking``: first against each bucket's earliest class, then
   between the components left, block against block, in units that return fewer links than they have classes).
4. Connected components of the links by alternating large-star and small-star.

A document without words has the empty set and is linked with nothing. Null texts count as empty. Rows that repeat an id are
rows of their own. A null id names a component only where no row of it has another. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, materialize
from .batches import pieces
from .linking import Rule, fingerprint, linked_components, named_rows
from .texthash import mix, shingle_sets

PERCENT = 85
MINIMA, ROWS = 128, 4
#: Least number of equal minima of a pair worth a look: at similarity 0.85 fewer come with probability 1e-9.
AGREE = 81
#: Shingles hashed at a time, few enough for the processor's cache.
STEP = 1 << 14

_SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:MINIMA] | np.uint64(1), _SEEDS[MINIMA:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima (columns) of each set (rows), upper halves; those of an empty set are the largest number."""
    out = np.full((len(sets), MINIMA), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = mix(np.concatenate([sets[i] for i in full]))
    ends = np.cumsum([len(sets[i]) for i in full])
    # sets are cut at every STEP-th value too, so that a stretch of cuts fits the cache whatever the set
    cuts = np.unique(np.concatenate([[0], ends[:-1], np.arange(0, len(values), STEP)]))
    least = np.empty((len(cuts), MINIMA), np.uint32)
    edges = np.append(cuts, len(values))
    at = 0
    while at < len(cuts):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + STEP, "right")) - 1)
        part, begin = values[edges[at] : edges[stop]], cuts[at:stop] - cuts[at]
        for k in range(MINIMA):
            least[at:stop, k] = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], begin) >> np.uint64(32)
        at = stop
    out[full] = np.minimum.reduceat(least, np.searchsorted(cuts, np.append(0, ends[:-1])), axis=0)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band (columns) of each signature (rows), different from band to band."""
    parts = minima.astype(np.uint64).reshape(len(minima), MINIMA // ROWS, ROWS)
    key = np.broadcast_to(np.arange(MINIMA // ROWS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD1B54A32D192ED03) + parts[:, :, r])
    return key.view(np.int64)


def may(sketch_a: np.ndarray, n_a: np.ndarray, sketch_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which signatures agree often enough."""
    a, b = (np.stack([np.frombuffer(x, np.uint32) for x in sketch]) for sketch in (sketch_a, sketch_b))
    step = max(1, (1 << 22) // a.size)
    equal = [(a[:, None] == b[None, at : at + step]).sum(2, dtype=np.int16) for at in range(0, len(b), step)]
    return np.concatenate(equal, axis=1) >= AGREE


RULE = Rule(PERCENT, may)


def _describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part in pieces(batch):
            sets = shingle_sets(part["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([x.tobytes() for x in signatures(sets)], pa.binary()),
                ],
                ["doc_id", "n", "fp", "sketch"],
            )


def _bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (tile, fp, n, rep) for each band of each class."""
    for batch in it:
        for at in range(0, batch.num_rows, 2048):
            rows = batch.slice(at, 2048)
            minima = np.stack([np.frombuffer(x, np.uint32) for x in rows["sketch"].to_pylist()])
            keys = band_keys(minima)
            again = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), *(rows[c].take(pa.array(again)) for c in ("fp", "n", "rep"))], ["tile", "fp", "n", "rep"]
            )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text); kept rows name their component."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    described = materialize(docs.mapInArrow(_describe, "doc_id long, n long, fp long, sketch binary"), "signatures")
    classes = described.filter("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")
    rows = materialize(classes.select("fp", "n", "rep", "sketch").mapInArrow(_bands, "tile long, fp long, n long, rep long"), "bands")
    buckets = rows.groupBy("tile").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")
    )
    buckets = buckets.filter("size > 1").groupBy("x", "y", "size").agg(F.min("tile").alias("tile"))
    tiles = materialize(rows.join(buckets.select("tile"), "tile"), "tiles")
    roots = linked_components(docs, classes, tiles, RULE)
    named = named_rows(described.select("doc_id", "n", "fp"), classes, roots)
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
