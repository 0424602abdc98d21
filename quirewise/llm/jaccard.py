"""Exact near-duplicate join on distinct five-word shingles: Jaccard similarity of 0.8 or more.

1. Texts with equal shingle sets fold into one class, named by a fingerprint of the set.
2. Two sets can only be similar if they share a shingle among the first n - ceil(0.8 n) + 1 of each in one common
   order. The order is by frequency (a fixed-size table of counts over all documents), rare shingles first.
   These prefixes are shuffled as packed blocks; a shingle met by several classes becomes a tile for each
   band of set sizes (bands grow by 1/0.8, so a similar pair is of one band or of two neighbouring ones).
3. In each tile (``linking``) every class is first compared with the tile's earliest one. Links found so far are joined
   into components; then the tiles that still hold several components compare across them, block against block.
4. A pair is first bounded from above with hashed bitmaps: each bit of one that the other lacks is a shingle it lacks.
   What the bound leaves is decided by the exact intersection of the two sorted sets, in the task that found it; a
   unit of classes returns fewer links than it has classes.

Pairs inside one component need no test, as only components are asked for; pairs between components are all tested.
A document without words has the empty set and is linked with nothing. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, materialize
from .batches import pieces
from .linking import Rule, fingerprint, linked_components, named_rows
from .texthash import mix, shingle_sets

COUNT_BITS = 18
COUNT_BLOCKS = 16
#: Prefix entries a packed block partition should hold, and those a map task gathers before it passes blocks on.
PART_ENTRIES, FLUSH_ENTRIES = 400_000, 250_000


def _key_counts(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in it:
        for part in pieces(batch):
            sets = shingle_sets(part["text"])
            counts += np.bincount(_key_counts(np.concatenate(sets)), minlength=1 << COUNT_BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([_bitmap(s) for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
                ],
                ["doc_id", "n", "fp", "bitmap", "block", "counts"],
            )
    blocks = counts.astype(np.int32).reshape(COUNT_BLOCKS, -1)
    yield pa.RecordBatch.from_arrays(
        [
            *(pa.nulls(COUNT_BLOCKS, pa.int64()) for _ in range(3)), pa.nulls(COUNT_BLOCKS, pa.binary()),
            pa.array(range(COUNT_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()),
        ],
        ["doc_id", "n", "fp", "bitmap", "block", "counts"],
    )


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << COUNT_BITS) // COUNT_BLOCKS, np.int64)
    for batch in batches:
        for x in batch["counts"]:
            total += np.frombuffer(x.as_buffer(), np.int32)
    yield pa.RecordBatch.from_arrays([batch["block"][:1], pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _prefixes(order, parts: int):
    """Packed blocks (part, keys, sets, sizes) of the prefix of every distinct set a task meets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, keys, owners, sizes, held = order.value, set(), [], [], [], 0
        for batch in it:
            for part in pieces(batch):
                for found in shingle_sets(part["text"]):
                    n, name = len(found), fingerprint(found)
                    if not n or name in seen:
                        continue
                    if len(seen) < 1_000_000:  # only spares repeats
                        seen.add(name)
                    p = n - (4 * n + 4) // 5 + 1
                    keys.append(found[np.lexsort((found, counts[_key_counts(found)]))[:p]])
                    owners.append(np.full(p, name, np.int64))
                    sizes.append(np.full(p, n, np.int32))
                    held += p
                if held >= FLUSH_ENTRIES:
                    yield _packed(keys, owners, sizes, parts)
                    keys, owners, sizes, held = [], [], [], 0
        if held:
            yield _packed(keys, owners, sizes, parts)

    return run


def _packed(keys: list, owners: list, sizes: list, parts: int) -> pa.RecordBatch:
    key, owner, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
    part = (mix(key) % np.uint64(parts)).astype(np.int64)
    at = np.argsort(part, kind="stable")
    which, begin = np.unique(part[at], return_index=True)
    cut = lambda x: pa.array([c.tobytes() for c in np.split(x[at], begin[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), cut(key), cut(owner), cut(size)], ["part", "keys", "sets", "sizes"])


def _band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)


def _tiles(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows (tile, fp, n) of the tiles of one part that two classes or more meet in."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["keys"]])
    fp = np.concatenate([np.frombuffer(x, np.int64) for x in frame["sets"]])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in frame["sizes"]])
    at = np.argsort(key, kind="stable")
    fresh = np.append(True, key[at][1:] != key[at][:-1])
    group = np.cumsum(fresh) - 1
    shared = np.bincount(group)[group] > 1
    key, fp, n = key[at][shared], fp[at][shared], n[at][shared]
    band = _band(n)
    # a class stands in the tile of its band, and as a guest in the next band's
    key, fp, n, band = np.tile(key, 2), np.tile(fp, 2), np.tile(n, 2), np.concatenate([band, band + 1])
    tile = mix(key ^ mix(band.astype(np.uint64))).view(np.int64)
    at = np.lexsort((fp, tile))
    tile, fp, n = tile[at], fp[at], n[at]
    fresh = np.append(True, (tile[1:] != tile[:-1]) | (fp[1:] != fp[:-1])) if len(tile) else np.zeros(0, bool)
    tile, fp, n = tile[fresh], fp[fresh], n[fresh]
    _, back, count = np.unique(tile, return_inverse=True, return_counts=True)
    kept = count[back] > 1
    return pd.DataFrame({"tile": tile[kept], "fp": fp[kept], "n": n[kept].astype(np.int64)})


def _bitmap(found: np.ndarray) -> bytes:
    """Hashed bitmap of a set, of 2 to 4 bits for each shingle, 128 to 8,192 in all."""
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * len(found) + 1)), 7, 13))
    out = np.zeros(bits, bool)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes that the same set would have."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def _bounds(maps_a: np.ndarray, n_a: np.ndarray, maps_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of each pair's overlap, rows by columns."""
    alone_a = np.bitwise_count(maps_a[:, None] & ~maps_b[None]).sum(2, dtype=np.int64)
    alone_b = np.bitwise_count(maps_b[None] & ~maps_a[:, None]).sum(2, dtype=np.int64)
    return np.minimum(n_a[:, None] - alone_a, n_b[None] - alone_b)


def may(sketch_a: np.ndarray, n_a: np.ndarray, sketch_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs the bound of their bitmaps leaves."""
    size = min(min(map(len, sketch_a)), min(map(len, sketch_b)))
    a, b = (np.stack([_folded(x, size) for x in m]) for m in (sketch_a, sketch_b))
    step = max(1, (1 << 18) // (len(a) * a.shape[1]))
    out = []
    for at in range(0, len(b), step):
        j = slice(at, at + step)
        out.append(RULE.linked(_bounds(a, n_a, b[j], n_b[j]), n_a[:, None], n_b[None, j]))
    return np.concatenate(out, axis=1)


RULE = Rule(80, may)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are not read).

    A component's id is its smallest doc_id. Rows that repeat an id are rows of their own with the same id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    described = materialize(docs.mapInArrow(_describe, "doc_id long, n long, fp long, bitmap binary, block int, counts binary"), "described")
    nodes = described.filter("block is null").select("doc_id", "n", "fp")
    blocks = described.filter("block is not null").select("block", "counts")
    table = np.zeros((COUNT_BLOCKS, (1 << COUNT_BITS) // COUNT_BLOCKS), np.int64)
    for row in blocks.groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect():
        table[row["block"]] = np.frombuffer(row["counts"], np.int64)
    order = spark.sparkContext.broadcast(table.reshape(-1))
    classes = materialize(
        described.filter("n > 0").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("bitmap").alias("sketch")), "classes"
    )
    parts = int(max(64, (classes.agg(F.sum("n")).first()[0] or 0) // 5 // PART_ENTRIES + 1))
    packed = docs.select("text").mapInArrow(_prefixes(order, parts), "part long, keys binary, sets binary, sizes binary")
    tiles = packed.groupBy("part").applyInPandas(_tiles, "tile long, fp long, n long")
    tiles = materialize(tiles.join(classes.select("fp", "rep"), "fp"), "tiles")

    return named_rows(nodes, classes, linked_components(docs, classes, tiles, RULE))
