"""Links between classes of equal shingle sets that meet in tiles, each decided on the full sets, never written out pair by pair.

A class is a shingle set, named by a fingerprint; a tile is a group of classes that may be similar. Only components are
asked for, so a pair inside one component needs no test, and links enough to join the components are enough:

1. Every class of a tile is compared with the tile's earliest one: a link at most for each row of a tile.
2. Links found so far give each class the name of a component. Tiles that hold several components are cut into blocks, and
   each pair of blocks meets in one group, where sketches are compared. What is returned is not pairs but units: classes
   connected by pairs that the sketches leave open. A family of similar texts makes the same unit in all its tiles.
3. Units get the full sets of their classes and are decided in tasks; components joined on the way drop out, so a unit
   returns fewer links than it has classes. First comes, for every class, the largest unit that it is in; of the others only
   what is connected by pairs of different components that no unit has tested, and so on until nothing is left.

A sketch gives an upper bound, or one that fails with a probability stated by its rule; sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .batches import pieces
from .components import components
from .texthash import mix, shingle_sets

#: Classes of one side of a block comparison, and the shingles they may hold together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Tile rows and shingles a task compares at a time, about.
BUNDLE, BUNDLE_SHINGLES = 1024, 1 << 20
FILTER_BITS = 1 << 23
#: Rows of units left from which on components are named anew between two rounds.
RENAMED_ROWS = 1 << 16
PAIR = "a long, b long, rep_b long"


@dataclass(frozen=True)
class Rule:
    """Sets are linked with ``100 * intersection >= percent * union``; ``may`` tells which sketches leave that possible.

    ``may`` takes the sketches and set sizes of two sides and gives a matrix of rows by columns.
    """

    percent: int
    may: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    def linked(self, overlap, n_a, n_b):
        return (100 + self.percent) * overlap >= self.percent * (n_a + n_b)


def fingerprint(found: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 only for the empty set."""
    if not len(found):
        return 0
    spread = mix(found + np.uint64(0x9E37))
    total = (int(spread.sum(dtype=np.uint64)) * 31 + int(np.bitwise_xor.reduce(spread)) + len(found)) % (1 << 64)
    value = mix(np.array([total], np.uint64))
    return int(value.view(np.int64)[0]) or 1


def _groups(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of the left and of the right side of each pair of blocks, and whether they are one block."""
    tile, i, j, side = (frame[c].to_numpy() for c in ("tile", "i", "j", "side"))
    order = np.lexsort((side, j, i, tile))
    tile, i, j, side = tile[order], i[order], j[order], side[order]
    lead = np.append(True, (tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(tile)]
    begin = np.flatnonzero(lead)
    for a, b in zip(begin, np.append(begin[1:], len(tile))[: len(begin)], strict=True):
        middle = a + int(np.searchsorted(side[a:b], 1))
        if i[a] == j[a]:
            yield order[a:b], order[a:b], True
        else:
            yield order[a:middle], order[middle:b], False


def _open_pairs(rule: Rule, left: np.ndarray, right: np.ndarray, same: bool, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Matrix of the pairs of different components that sizes and sketches leave, one half of it within one block."""
    n_a, n_b = n[left], n[right]
    ok = (comp[left][:, None] != comp[right][None]) & rule.linked(np.minimum(n_a[:, None], n_b[None]), n_a[:, None], n_b[None])
    if same:
        ok = np.triu(ok, 1)
    rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if len(rows):
        ok[np.ix_(rows, columns)] &= rule.may(sketch[left[rows]], n_a[rows], sketch[right[columns]], n_b[columns])
    return ok


UNIT = "unit long, fp long, n long, comp long"


def _units(rule: Rule):
    """Rows (unit, fp, n, comp) of the classes in pairs left open, by what such pairs connect in each pair of blocks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fp, comp, n, sketch = (frame[c].to_numpy() for c in ("fp", "comp", "n", "sketch"))
        units, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right, same in _groups(frame):
            if len(left) and len(right):
                ok = _open_pairs(rule, left, right, same, comp, n, sketch)
                rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if len(rows):
                    some, label = _connected(ok[np.ix_(rows, columns)], left[rows], right[columns])
                    members.append(some)
                    units.append(_unit_names(fp[some], label))
        unit, at = np.concatenate(units), np.concatenate(members)
        return pd.DataFrame({"unit": unit, "fp": fp[at], "n": n[at], "comp": comp[at]}).drop_duplicates(["unit", "fp"])

    return run


def _untested(rule: Rule):
    """Rows (unit, fp, n, comp) of what is connected by open pairs that no earlier unit held both classes of."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["unit", "fp"])
        unit, fp, comp, n, sketch = (frame[c].to_numpy() for c in ("unit", "fp", "comp", "n", "sketch"))
        tested = frame["tested"].to_list()
        units, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])[: len(unit)]), len(unit))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = np.arange(a, b)
            ok = _open_pairs(rule, rows, rows, True, comp, n, sketch)
            lists = [np.array([] if x is None else x, np.int64) for x in tested[a:b]]
            held, place = np.unique(np.concatenate(lists), return_inverse=True)
            if len(held):
                inside = np.zeros((b - a, len(held)), np.float32)
                inside[np.repeat(np.arange(b - a), [len(x) for x in lists]), place] = 1
                ok &= (inside @ inside.T) == 0
            left, right = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if len(left):
                some, label = _connected(ok[np.ix_(left, right)], rows[left], rows[right])
                members.append(some)
                units.append(_unit_names(fp[some], label))
        unit, at = np.concatenate(units), np.concatenate(members)
        return pd.DataFrame({"unit": unit, "fp": fp[at], "n": n[at], "comp": comp[at]}).drop_duplicates(["unit", "fp"])

    return run


def _connected(ok: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``rows`` and ``columns``, and for each the smallest place that open pairs connect it with."""
    some, place = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    down, across = place[: len(rows)], place[len(rows) :]
    label = np.arange(len(some))
    while True:
        before = label.copy()
        np.minimum.at(label, down, np.where(ok, label[across][None], len(some)).min(1))
        np.minimum.at(label, across, np.where(ok, label[down][:, None], len(some)).min(0))
        label = label[label]
        if (label == before).all():
            return some, label


def _unit_names(fp: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A name for each row's group, the same wherever the same classes are connected."""
    total, count = np.zeros(len(fp), np.uint64), np.bincount(label, minlength=len(fp)).astype(np.uint64)
    np.add.at(total, label, mix(fp.view(np.uint64)))
    return mix(total * np.uint64(31) + count)[label].view(np.int64)


class _Components:
    """Union-find over component names."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _forest(rule: Rule):
    """Links (a, b) that join the components of each unit, fewer than it has classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["unit", "fp"])
        unit, fp, comp, n, sketch, found = (frame[c].to_numpy() for c in ("unit", "fp", "comp", "n", "sketch", "found"))
        out = []
        edges = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])[: len(unit)]), len(unit))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = np.arange(a, b)
            ok = _open_pairs(rule, rows, rows, True, comp, n, sketch)
            sets = [np.frombuffer(x, np.uint64) for x in found[a:b]]
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            ids = np.split(number, np.cumsum([len(s) for s in sets])[:-1])
            mark, joined = np.zeros(int(number.max()) + 1, bool), _Components()
            for x in np.flatnonzero(ok.any(1)):
                mine = joined.root(int(comp[a + x]))
                columns = [y for y in np.flatnonzero(ok[x]).tolist() if joined.root(int(comp[a + y])) != mine]
                if not columns:
                    continue
                mark[ids[x]] = True
                size = [len(ids[y]) for y in columns]
                met = mark[np.concatenate([ids[y] for y in columns])].astype(np.int64)
                overlap = np.add.reduceat(met, np.append(0, np.cumsum(size)[:-1]))
                mark[ids[x]] = False
                for k in np.flatnonzero(rule.linked(overlap, n[a + x], n[a + np.array(columns)])):
                    if joined.join(int(comp[a + x]), int(comp[a + columns[k]])):
                        out.append((fp[a + x], fp[a + columns[k]]))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def _decide_units(docs: DataFrame, classes: DataFrame, units: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) within the written ``units`` (unit, fp, n, comp)."""
    rows, shingles = units.agg(F.count(F.lit(1)), F.sum("n")).first()
    bundles = max(64, rows // BUNDLE, (shingles or 0) // BUNDLE_SHINGLES)
    sets = _sets_of(docs, classes, units.select("fp").distinct())
    sketches = classes.select("fp", "sketch")
    shipped = units.join(sets, "fp").join(sketches, "fp").select("unit", "fp", "n", "comp", "sketch", "found")
    return shipped.groupBy(F.pmod("unit", F.lit(bundles))).applyInPandas(_forest(rule), "a long, b long")


def _possible(rule: Rule):
    """Pairs that the sketches leave."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = zip(*(batch[c].to_pylist() for c in ("sketch_a", "n_a", "sketch_b", "n_b")), strict=True)
            may = [bool(rule.may(_column(x), np.array([n]), _column(y), np.array([m]))[0, 0]) for x, n, y, m in rows]
            yield batch.select(["a", "b", "rep_b"]).filter(pa.array(may, pa.bool_()))

    return run


def _column(value: bytes) -> np.ndarray:
    out = np.empty(1, object)
    out[0] = value
    return out


def _decided(rule: Rule):
    """Pairs whose sorted sets are similar."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            similar = []
            for set_a, set_b in zip(*(batch[c].to_pylist() for c in ("set_a", "set_b")), strict=True):
                both = np.concatenate([np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)])
                both.sort()
                similar.append(bool(rule.linked(int((both[1:] == both[:-1]).sum()), len(set_a) // 8, len(set_b) // 8)))
            yield batch.select(["a", "b", "rep_b"]).filter(pa.array(similar, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(fp, found) of the needed classes.

    Documents are picked out by a bitmap of hashed ids of FILTER_BITS bits, whatever the number of ids;
    the few that only look needed drop out in the join with the pairs.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    marked = (
        needed.join(classes, "fp").select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    table = bytearray(FILTER_BITS // 8)
    for row in marked.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        table[at : at + 4096] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(table))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for batch in it:
            batch = batch.filter(pa.array(marks[batch["place"].to_numpy()].astype(bool)))
            for part in pieces(batch):
                sets = [s for s in shingle_sets(part["text"]) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["fp", "found"],
                )

    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"), "text")
    found = texts.mapInArrow(run, "fp long, found binary")
    return materialize(found.join(needed, "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of the written ``pairs`` (a, b, rep_b) that are similar; only the sets of these pairs are fetched."""
    needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "fp")
    sets = _sets_of(docs, classes, needed)
    one, two = (sets.select(F.col("fp").alias(x), F.col("found").alias(f"set_{x}")) for x in ("b", "a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "rep_b", "set_a", "set_b").mapInArrow(_decided(rule), PAIR)


def _similar_sizes(a: Column, b: Column, rule: Rule) -> Column:
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def linked_components(docs: DataFrame, classes: DataFrame, tiles: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the written ``classes`` (fp, rep, n, sketch) that have links within ``tiles``.

    ``docs`` (doc_id, text) hold the texts of the classes, a class that of its ``rep``; ``tiles`` (tile, fp, n, rep)
    are written rows.
    """
    found = first_links(docs, classes, tiles, rule)
    units = open_units(classes, tiles, found, rule)
    if units is None:
        return components(found.select("a", "b"))
    found, tested = found.select("a", "b"), None
    while True:
        # every class asks for its largest unit; what no unit has tested by then is left for another round
        largest = units.join(units.groupBy("unit").agg(F.count("*").alias("size")), "unit")
        asked = largest.groupBy("fp").agg(F.max(F.struct("size", "unit")).alias("m")).select(F.col("m.unit").alias("unit")).distinct()
        asked = materialize(asked, "asked-units")
        some = materialize(units.join(asked, "unit", "left_semi"), "units-in-turn")
        found = materialize(found.union(_decide_units(docs, classes, some, rule)), "links")
        rest = materialize(units.join(asked, "unit", "left_anti"), "other-units")
        rows = rest.count()
        if rows > RENAMED_ROWS:  # worth the rounds that it takes to name components anew: units of one component drop out
            roots = components(found).withColumnRenamed("node", "fp")
            rest = rest.join(roots, "fp", "left").select("unit", "fp", "n", F.coalesce("root", "comp").alias("comp"))
            rest = materialize(rest, "renamed-units")
            mixed = rest.groupBy("unit").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
            rest = rest.join(mixed.select("unit"), "unit", "left_semi")
        tested = some.select("fp", "unit") if tested is None else tested.union(some.select("fp", "unit"))
        known = tested.groupBy("fp").agg(F.collect_list("unit").alias("tested"))
        rest = rest.join(known, "fp", "left").join(classes.select("fp", "sketch"), "fp").select("unit", "fp", "n", "comp", "sketch", "tested")
        bundle = F.pmod("unit", F.lit(max(64, rows // BUNDLE)))
        units = rest.groupBy(bundle).applyInPandas(_untested(rule), UNIT).dropDuplicates(["unit", "fp"])
        units = materialize(units, "units")
        if not rows or units.isEmpty():
            return components(found)


def first_links(docs: DataFrame, classes: DataFrame, tiles: DataFrame, rule: Rule) -> DataFrame:
    """Written links (a, b, rep_b) of classes with the earliest class of a tile."""
    first = tiles.groupBy("tile").agg(F.min(F.struct("rep", "fp", "n")).alias("first"))
    pairs = (
        tiles.join(first, "tile").filter((F.col("fp") != F.col("first.fp")) & _similar_sizes(F.col("n"), F.col("first.n"), rule))
        .select(F.col("fp").alias("a"), F.col("first.fp").alias("b"), F.col("first.rep").alias("rep_b")).distinct()
    )
    one, two = (
        classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("b", "a")
    )
    pairs = pairs.join(one, "b").join(two, "a").select("a", "b", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_possible(rule), PAIR)
    return materialize(_linked(docs, classes, materialize(pairs, "star-pairs"), rule), "star-links")


def open_units(classes: DataFrame, tiles: DataFrame, found: DataFrame, rule: Rule) -> DataFrame | None:
    """Written units (unit, fp, n, comp) of the tiles that hold several components by the links ``found``; None without any."""
    # a class takes the name of its earliest partner, and then that one's: never a wrong name, at worst too many names
    parent = found.groupBy("a").agg(F.min(F.struct("rep_b", "b")).alias("p")).select(F.col("a").alias("fp"), F.col("p.b").alias("up"))
    above = parent.select(F.col("fp").alias("up"), F.col("up").alias("top"))
    named = parent.join(above, "up", "left").select("fp", F.coalesce("top", "up").alias("root"))
    labelled = tiles.join(named, "fp", "left").select("tile", "fp", "n", F.coalesce("root", "fp").alias("comp"))
    labelled = materialize(labelled, "labelled")
    # the shingles of one passage make tiles of the same classes: one of each such set is enough
    mixed = labelled.groupBy("tile").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.max("n").alias("longest"),
        F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"),
    )
    mixed = mixed.filter("low != high").groupBy("x", "y", "size", "longest").agg(F.min("tile").alias("tile"))
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("longest"))))
    blocks = F.ceil(F.col("size") / block).cast("long")
    open_tiles = materialize(labelled.join(mixed.select("tile", blocks.alias("blocks")), "tile"), "open-tiles")
    rows = open_tiles.agg(F.sum("blocks")).first()[0]
    if not rows:
        return None
    bundles = max(64, rows // BUNDLE)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    sides = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).cast("int").alias("side")),
    )
    units = (
        open_tiles.withColumn("at", F.explode(sides)).select("tile", "at.i", "at.j", "at.side", "fp", "n", "comp")
        .join(classes.select("fp", "sketch"), "fp").select("tile", "i", "j", "side", "fp", "n", "comp", "sketch")
        .groupBy(F.pmod(F.xxhash64("tile", "i", "j"), F.lit(bundles))).applyInPandas(_units(rule), UNIT)
    )
    return materialize(units.dropDuplicates(["unit", "fp"]), "units")


def named_rows(nodes: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the written ``nodes`` (doc_id, n, fp), given (node, root) of linked classes.

    A component is named by its smallest doc_id; a document without shingles by its own.
    """
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = named.join(names, "root").select("fp", "component_id")
    return nodes.join(of_class, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
