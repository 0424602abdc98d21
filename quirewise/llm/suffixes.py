"""Suffix-array dedup: find and cut every 50-byte string that an earlier document has too.

Texts are UTF-8 bytes; null counts as empty; matches never cross documents. A byte goes if some 50-byte string that
covers it also starts in a document with a smaller doc_id. Strings are judged on the input.

How the work is spread:

1. Sampled suffixes. Of every 25 neighbouring positions the one whose next 26 bytes hash lowest is kept, so any common
   50-byte string holds the same kept position in both documents. Each kept suffix carries a hash of the 74 bytes around
   it, which are all the 50-byte strings through it. Suffixes are shuffled as packed blocks by their first 26 bytes.
2. A logarithmic family of suffix arrays. Each part takes its suffixes in batches of ascending doc_id. A batch is sorted
   into a suffix array (by the hash of the first 26 bytes, then of the surroundings), merge-scanned against the
   arrays of all levels before it, and added; two arrays of one size merge into one of the next. A level only needs each
   distinct (first bytes, surroundings) once, with its smallest document.
   A suffix found with equal surroundings in a smaller document is covered whole.
3. Borders. Suffixes that share their first 26 bytes but not their surroundings with another document may share
   some of the strings through them. Those strings are shuffled by their own hashes, so common first bytes spread.
   Before both shuffles a task sends, of the rows it has gathered, only those of each key's smallest document;
   the others are covered already. Of first bytes that very many of its rows share, with surroundings of their own, it
   sends the smallest document's only: the others have met an earlier document and go to step 3 right away.
4. The covered stretches meet their texts and are cut out.

Strings are told apart by 64-bit hashes of their bytes, not compared byte by byte.

An existing index can be passed on: ``suffixes`` and ``scan_part`` take any earlier rows as a first batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import bound_batches, materialize
from .batches import pieces
from .texthash import mix, text_bytes

LENGTH = 50
FIRST = 26
AROUND = LENGTH - FIRST
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text worked on at once, suffixes in a part, suffixes a map task gathers before it passes blocks on.
WORK_BYTES, PART_SUFFIXES, FLUSH_SUFFIXES = 1 << 20, 500_000, 600_000
#: Suffixes of a batch of the index family.
BATCH = 1 << 16
#: Suffixes of one first bytes that a task sends to their part at a time; of more, all but the smallest document's go to step 3.
HOT = 64

_POWERS = np.cumprod(np.full(WORK_BYTES + 4096, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(WORK_BYTES + 4096, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: two of them give the hash of any range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    return sums


def _range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes ``begin`` to ``end``, the same wherever they stand."""
    return mix((sums[end] - sums[begin]) * _INVERSE[begin] + (end - begin).astype(np.uint64))


def _window(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over each ``width`` neighbours."""
    done, out = 1, values
    while done * 2 <= width:
        out = combine(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return combine(out[: len(out) - rest], out[rest:]) if rest else out


def _sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions in ``data``, hash of their first bytes, and hash of their surroundings."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = _prefix_hash(data)
    n = len(data) - FIRST + 1
    first = (sums[FIRST:] - sums[:n]) * _INVERSE[:n]
    first = mix(first)
    for end in offsets[1:-1]:  # first bytes that reach over the end of a text are never the lowest
        first[max(0, end - FIRST + 1) : end] = _NONE
    low = _window(first, AROUND + 1, np.minimum)
    padded = np.concatenate([np.zeros(AROUND, np.uint64), low, np.zeros(AROUND, np.uint64)])
    kept = np.flatnonzero((_window(padded, AROUND + 1, np.maximum) == first) & (first != _NONE))
    text = np.searchsorted(offsets, kept, "right") - 1
    begin, end = np.maximum(kept - AROUND, offsets[text]), np.minimum(kept + LENGTH, offsets[text + 1])
    return kept, first[kept], _range_hash(sums, begin, end)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(data, offsets, doc_id, tag, start in its text, first and last place to take suffixes from) of pieces of at most WORK_BYTES.

    A longer text comes in pieces that overlap, and each gives the suffixes whose surroundings lie inside it or
    end with the text, so none is hashed with surroundings that a cut has shortened.
    """
    ids, tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy()
    for part_at in range(0, batch.num_rows, 4096):
        rows = batch.slice(part_at, 4096)
        data, offsets = text_bytes(rows["text"])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORK_BYTES, "right")) - 1)
            base, size = offsets[at], offsets[stop] - offsets[at]
            doc, tag = ids[part_at + at : part_at + stop], tags[part_at + at : part_at + stop]
            if size <= WORK_BYTES:
                yield data[base : base + size], offsets[at : stop + 1] - base, doc, tag, np.zeros(stop - at, np.int64), 0, size
            else:  # one long text
                step = WORK_BYTES - 4 * LENGTH
                for start in range(0, size - 4 * LENGTH, step):
                    part = data[base + start : base + min(size, start + WORK_BYTES)]
                    last = len(part) if start + len(part) == size else len(part) - LENGTH
                    yield part, np.array([0, len(part)]), doc, tag, np.array([start]), AROUND if start else 0, last
            at = stop


def _suffix_blocks(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = 0, []
        for batch in it:
            for data, offsets, doc, tag, start, low, last in _stretches(batch):
                found = _sampled(data, offsets)
                inside = (found[0] >= low) & (found[0] <= last)
                kept, first, around = (x[inside] for x in found)
                text = np.searchsorted(offsets, kept, "right") - 1
                gathered.append((first, around, doc[text], tag[text], kept - offsets[text] + start[text]))
                held += len(kept)
                if held >= FLUSH_SUFFIXES:
                    yield from _packed(gathered, parts)
                    held, gathered = 0, []
        if held:
            yield from _packed(gathered, parts)

    return run


def _squeezed(values: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane, compressed: rising or repeated numbers take little."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unsqueezed(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _met_before(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a smaller document of these rows has the same key: covered, whatever other tasks hold."""
    order = np.lexsort((doc, key))
    lead = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    out = np.zeros(len(key), bool)
    out[order] = doc[order] > _leader(doc[order], lead)
    return out


def _blocks(part: np.ndarray, columns: dict[str, np.ndarray], doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part."""
    order = np.lexsort((place, tag, doc, part))
    which, begin = np.unique(part[order], return_index=True)

    def cut(values: np.ndarray, pack=np.ndarray.tobytes) -> pa.Array:
        return pa.array([pack(c) for c in np.split(values[order], begin[1:])] if len(which) else [], pa.binary())

    arrays = [*(cut(x) for x in columns.values()), *(cut(x, _squeezed) for x in (doc, tag, place))]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), *arrays], ["part", *columns, "docs", "tags", "places"])


def _folded(parts: int, known: np.ndarray, part: np.ndarray, columns: dict, rows: tuple, open_ends: np.ndarray | None = None):
    """Packed rows by part; then what is covered for certain (``known``), and what only step 3 can tell, spread by document."""
    ask = ~known if open_ends is None else ~known & ~open_ends
    yield _blocks(part[ask], {c: x[ask] for c, x in columns.items()}, *(x[ask] for x in rows))
    for some, mark in ((known, None), (open_ends, b"")):
        if some is not None and some.any():
            spread = (mix(rows[0][some].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            made = _blocks(spread, {}, *(x[some] for x in rows))
            # no first bytes: not to be looked up; then surroundings tell what is covered from what is open
            marks = [pa.nulls(made.num_rows, pa.binary())] + [pa.array([mark] * made.num_rows, pa.binary())] * (len(columns) - 1)
            arrays = [made["part"], *marks, made["docs"], made["tags"], made["places"]]
            yield pa.RecordBatch.from_arrays(arrays, ["part", *columns, "docs", "tags", "places"])


def _hot(first: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows of ``left`` whose first bytes over HOT of them share, but for those of the smallest document."""
    at = np.flatnonzero(left)
    at = at[np.lexsort((doc[at], first[at]))]
    lead = np.append(True, first[at][1:] != first[at][:-1])[: len(at)]
    group = np.cumsum(lead) - 1
    out = np.zeros(len(first), bool)
    out[at] = (np.bincount(group, minlength=1)[group] > HOT) & (doc[at] > _leader(doc[at], lead)) if len(at) else False
    return out


def _packed(gathered: list, parts: int) -> Iterator[pa.RecordBatch]:
    first, around, doc, tag, place = (np.concatenate(x) for x in zip(*gathered, strict=True))
    part = (first % np.uint64(parts)).astype(np.int64)
    columns = {"first": (first // np.uint64(parts)).astype(np.uint32), "around": around}
    known = _met_before(mix(first) ^ around, doc)
    yield from _folded(parts, known, part, columns, (doc, tag, place), _hot(first, doc, ~known))


def _places(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Documents, tags and places of packed rows."""
    kinds = (("docs", np.int64), ("tags", np.int32), ("places", np.int64))
    return tuple(np.concatenate([np.zeros(0, k), *(_unsqueezed(x, k) for x in frame[c])]) for c, k in kinds)


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    first = np.frombuffer(b"".join(frame["first"]), np.uint32)
    around = np.frombuffer(b"".join(frame["around"]), np.uint64)
    return first, around, *_places(frame)


class IndexFamily:
    """Suffix arrays in levels of geometrically growing size, filled by batches of ascending doc_id.

    An array holds (first, around, doc), sorted, each (first, around) once with its smallest document.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def find(self, first: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Whether a document of an earlier batch has these first bytes in these surroundings."""
        seen = np.zeros(len(first), bool)
        wanted = _joint(first, around)
        for a, b, _ in self.levels:
            known = _joint(a, b)
            at = np.searchsorted(known, wanted)
            live = np.flatnonzero(at < len(known))
            while len(live):  # once or twice: joint keys hardly ever repeat
                live = live[known[at[live]] == wanted[live]]
                seen[live] |= b[at[live]] == around[live]
                at[live] += 1
                live = live[~seen[live] & (at[live] < len(known))]
        return seen

    def add(self, first: np.ndarray, around: np.ndarray, doc: np.ndarray) -> None:
        """Add a sorted array as a level of its own, and merge while the last level is not larger."""
        new = (first, around, doc)
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            old = self.levels.pop()
            joined = [np.concatenate(x) for x in zip(old, new, strict=True)]
            new = _sorted_once(*joined)
        self.levels.append(new)


def _joint(first: np.ndarray, around: np.ndarray) -> np.ndarray:
    """64 bits in the order of (first, around)."""
    return (first.astype(np.uint64) << np.uint64(32)) | (around >> np.uint64(32))


def _sorted_once(first: np.ndarray, around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, around, first))
    first, around, doc = first[order], around[order], doc[order]
    fresh = np.append(True, (first[1:] != first[:-1]) | (around[1:] != around[:-1]))
    return first[fresh], around[fresh], doc[fresh]


def _scan_part(frame: pd.DataFrame) -> pd.DataFrame:
    """For each document, packed: places of suffixes covered whole, and of those to compare at their borders."""
    known, unsure = frame["first"].isna(), frame["around"].notna()
    sure, open_ends, frame = frame[known & ~unsure], frame[known & unsure], frame[~known]
    first, around, doc, tag, place = _unpacked(frame)
    order = np.lexsort((place, tag, doc))
    first, around, doc, tag, place = (x[order] for x in (first, around, doc, tag, place))
    covered = np.zeros(len(first), bool)
    family = IndexFamily()
    at = 0
    while at < len(first):
        end = int(np.searchsorted(doc, doc[min(len(first), at + BATCH) - 1], "right"))  # a document is never split
        f, a, d = first[at:end], around[at:end], doc[at:end]
        own = np.lexsort((d, a, f))
        lead = np.append(True, (f[own][1:] != f[own][:-1]) | (a[own][1:] != a[own][:-1]))
        later = np.zeros(len(f), bool)
        later[own] = d[own] > _leader(d[own], lead)
        covered[at:end] = later | family.find(f, a)
        family.add(f[own][lead], a[own][lead], d[own][lead])
        at = end
    # first bytes that several documents have in surroundings of their own; what is covered has a witness here
    left = np.flatnonzero(~covered)
    order = left[np.lexsort((doc[left], first[left]))]
    f, d = first[order], doc[order]
    lead = np.append(True, f[1:] != f[:-1])[: len(f)]
    tail = np.append(f[1:] != f[:-1], True)[: len(f)]
    border = order[(d[tail] > d[lead])[np.cumsum(lead) - 1]]
    rows = np.concatenate([np.flatnonzero(covered), border])
    more, still = _places(sure), _places(open_ends)
    doc, tag, place = (np.concatenate([x[rows], y, z]) for x, y, z in zip((doc, tag, place), more, still, strict=True))
    whole = np.concatenate([covered[rows], np.ones(len(more[0]), bool), np.zeros(len(still[0]), bool)])
    rows = np.lexsort((place, tag, doc))
    doc, tag, place, whole = doc[rows], tag[rows], place[rows], whole[rows]
    lead = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(doc)]
    out = []
    for i, j in _ranges(lead):
        w = whole[i:j]
        out.append((doc[i], tag[i], place[i:j][w].tobytes(), place[i:j][~w].tobytes()))
    return pd.DataFrame(out, columns=["doc_id", "tag", "whole", "border"])


def _ranges(lead: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each group, given where groups begin."""
    begin = np.flatnonzero(lead)
    return zip(begin, [*begin[1:], len(lead)][: len(begin)], strict=True)


def _leader(values: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """For each row the value of the last row up to it that leads a group."""
    return values[np.maximum.accumulate(np.where(lead, np.arange(len(values)), 0))]


def _string_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the 50 bytes from each position."""
    value = np.zeros(len(at), np.uint64)
    for i in range(LENGTH):
        value = value * _BASE + data[at + i] + np.uint64(1)
    return mix(value)


def _strings(parts: int):
    """The 50-byte strings through each text's border suffixes, packed by their hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = 0, []
        for batch in it:
            for rows in pieces(batch):
                data, offsets = text_bytes(rows["text"])
                ids, tags = rows["doc_id"].to_numpy(), rows["tag"].to_numpy()
                for i, lists in enumerate(rows["border"].to_pylist()):
                    place, size = np.frombuffer(b"".join(lists), np.int64), int(offsets[i + 1] - offsets[i])
                    begin, end = np.maximum(place - AROUND, 0), np.minimum(place + AROUND + FIRST, size) - LENGTH + 1
                    steps = np.zeros(size + 2, np.int32)
                    long = end > begin
                    np.add.at(steps, begin[long], 1)
                    np.add.at(steps, end[long], -1)
                    begins = np.flatnonzero(np.cumsum(steps) > 0)
                    for at in range(0, len(begins), FLUSH_SUFFIXES):
                        some = begins[at : at + FLUSH_SUFFIXES]
                        gathered.append((_string_hash(data, some + offsets[i]), np.full(len(some), ids[i]), np.full(len(some), tags[i]), some))
                        held += len(some)
                        if held >= FLUSH_SUFFIXES:
                            yield from _packed_strings(gathered, parts)
                            held, gathered = 0, []
        if held:
            yield from _packed_strings(gathered, parts)

    return run


def _packed_strings(gathered: list, parts: int) -> Iterator[pa.RecordBatch]:
    key, doc, tag, place = (np.concatenate(x) for x in zip(*gathered, strict=True))
    yield from _folded(parts, _met_before(key, doc), (key % np.uint64(parts)).astype(np.int64), {"keys": key}, (doc, tag, place))


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """For each document, packed: starts of the 50-byte strings of this part that a smaller document has."""
    known = frame["keys"].isna()
    asked = frame[~known]
    rows = _places(asked)
    hit = _met_before(np.frombuffer(b"".join(asked["keys"]), np.uint64), rows[0])
    doc, tag, place = (np.append(x[hit], y) for x, y in zip(rows, _places(frame[known]), strict=True))
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    lead = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(doc)]
    out = [(doc[i], tag[i], place[i:j].tobytes()) for i, j in _ranges(lead)]
    return pd.DataFrame(out, columns=["doc_id", "tag", "begins"])


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal joined runs (rows of begin, end) of the given ranges."""
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[fresh], np.append(end[:-1][fresh[1:]], end[-1])], axis=1)


def removed_runs(size: int, whole: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Runs to remove from a text of ``size`` bytes: surroundings of covered suffixes, and 50-byte strings."""
    begin, end = np.maximum(whole - AROUND, 0), np.minimum(whole + LENGTH, size)
    long = end - begin >= LENGTH
    return _runs(np.concatenate([begin[long], begins]), np.concatenate([end[long], begins + LENGTH]))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, had_text boolean"


def _cut(carry: list[str]):
    """Cut the runs out of each text; ``carry`` columns pass through."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_()]
        names = [f.strip().split(" ")[0] for f in CUT.split(",")]
        for batch in it:
            for part in pieces(batch):
                out = []
                for doc, text, whole, begins in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "whole", "begins")), strict=True):
                    raw = (text or "").encode()
                    runs = removed_runs(
                        len(raw), np.frombuffer(b"".join(whole or []), np.int64), np.frombuffer(b"".join(begins or []), np.int64)
                    )
                    at, kept = 0, []
                    for begin, end in runs.tolist():
                        kept.append(raw[at:begin])
                        at = end
                    kept = b"".join([*kept, raw[at:]])
                    whole_text = kept.decode(errors="ignore")
                    out.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), whole_text, text is not None))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(part[f"_{c}"] for c in carry)], [*names, *(f"_{c}" for c in carry)])

    return run


def tagged(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, tag, text) and ``carry`` under other names: the tag tells rows apart that repeat an id with another text."""
    return docs.select("doc_id", F.hash("text").alias("tag"), "text", *(F.col(f"`{c}`").alias(f"_{c}") for c in carry))


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, whole) of suffixes covered, and (doc_id, tag, begins) of strings found at borders, both packed."""
    bound_batches(docs.sparkSession)
    texts = tagged(docs).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(64, size // 13 // PART_SUFFIXES + 1))
    blocks = texts.mapInArrow(
        _suffix_blocks(parts), "part long, first binary, around binary, docs binary, tags binary, places binary"
    )
    found = materialize(
        blocks.groupBy("part").applyInPandas(_scan_part, "doc_id long, tag int, whole binary, border binary"),
        "suffixes-found",
    )
    open_ends = (
        found.filter(F.octet_length("border") > 0).groupBy("doc_id", "tag")
        .agg(F.collect_list("border").alias("border"))
    )
    packed = "part long, keys binary, docs binary, tags binary, places binary"
    strings = texts.join(open_ends, ["doc_id", "tag"]).mapInArrow(_strings(parts), packed)
    strings = strings.groupBy("part").applyInPandas(_compare, "doc_id long, tag int, begins binary")
    return found.filter(F.octet_length("whole") > 0).select("doc_id", "tag", "whole"), materialize(strings, "strings-found")


def remove_repeats(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, had_text) of every row of ``docs`` (doc_id, text), and ``carry``.

    kept_text is what can be read of the remaining bytes; kept_sha256 is over the bytes. Rows without an id neither lose
    bytes nor take them from others. Rows that repeat an id do not count as earlier than each other.
    """
    whole, strings = removals(docs)
    per_doc = (
        whole.select("doc_id", "tag", "whole", F.lit(None).cast("binary").alias("begins"))
        .union(strings.select("doc_id", "tag", F.lit(None).cast("binary"), "begins"))
        .groupBy("doc_id", "tag").agg(F.collect_list("whole").alias("whole"), F.collect_list("begins").alias("begins"))
    )
    texts = tagged(docs, carry)
    kept = StructType([*_parse_datatype_string(CUT).fields, *(texts.schema[f"_{c}"] for c in carry)])
    cut = texts.join(per_doc, ["doc_id", "tag"], "left").mapInArrow(_cut(list(carry)), kept)
    return cut.withColumnsRenamed({f"_{c}": c for c in carry})
