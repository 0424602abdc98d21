"""Periodic runs of words: every maximal repetition of a whole text, and the text with the repeats taken out.

Words are the stretches of bytes other than the six ASCII white-space bytes, compared exactly. A run is a stretch of
consecutive words with smallest period q and at least 2 * q words that no neighbour extends. All are found:

1. Periods up to SMALL are found directly, by comparing each word with the one q places on. They are the highly periodic
   regions of the scales above, which those scales leave out.
2. At each dyadic scale t = 4, 8, 16, ... a string synchronising set marks positions: windows of t words are named by
   hashes doubled from scale to scale, and a position is kept if the lowest name among the windows that start in its
   next t + 1 places is that of the first or the last. Windows with a period of at most t / 3 have no name. What is kept
   depends on the next 2 t words alone, so equal contexts are kept alike; and any t neighbours hold a kept position
   unless the 3 t - 1 words from there have a period of at most t / 3.
3. Kept positions with equal contexts at a distance q in [3 t - 1, 6 t - 1) propose q. A run of such a period has t
   neighbours whose contexts recur q places on, so it is proposed, unless its whole period is one highly periodic region.
   Equal contexts stand over t / 3 apart, so a position has at most 18 partners.
4. In the case left out the run's two periods lie in two neighbouring regions of one small period p whose words fall
   in the same order. For neighbouring regions of one period the shifts that align them propose the missing q.
5. A proposal is decided by comparing words outwards from it; equal stretches keep their smallest period.

Texts are worked through in pieces of about PIECE bytes, all texts of a piece at once, a longer text alone. A text is held
by one task with some 25 bytes for each of its own. Null and empty texts have no words and no runs. Rows that repeat an
id are rows of their own. Other columns are carried along; same names as the new columns are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .batches import pieces
from .texthash import mix

#: Periods found directly, and the first scale, whose periods begin right after them (3 * 4 - 1 = 11).
SMALL, FIRST_SCALE = 10, 4
PIECE = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
NEW = {
    **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), pa.int64()),
    **dict.fromkeys(("runs_sha256", "collapsed_sha256", "collapsed_text"), pa.string()),
}


def _joined(parts: list[Runs]) -> Runs:
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def _smallest(runs: Runs) -> Runs:
    """Each stretch (begin, end) once, with its smallest period."""
    begin, end, period = runs
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    fresh = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))[: len(begin)]
    return begin[fresh], end[fresh], period[fresh]


def _small_periods(x: np.ndarray) -> Runs:
    found = []
    for q in range(1, min(SMALL, len(x) // 2) + 1):
        edge = np.flatnonzero(np.diff((x[q:] == x[:-q]).astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        kept = end - begin >= q
        found.append((begin[kept], end[kept] + q, np.full(int(kept.sum()), q, np.int64)))
    return _smallest(_joined(found))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours; ``width`` is a power of two."""
    done = 1
    while done < width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values


def _inside(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Where any of the ranges covers a position."""
    steps = np.bincount(begin, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1]
    return np.cumsum(steps[:size]) > 0


def synchronising_set(names: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """Kept positions, from the names of windows of ``scale`` words and where such a window is highly periodic."""
    key = np.where(periodic, _NONE, names)
    if len(key) <= scale:
        return np.zeros(0, np.int64)
    low = np.minimum(_lowest(key, scale)[: len(key) - scale], key[scale:])
    return np.flatnonzero((low != _NONE) & ((key[: len(low)] == low) | (key[scale:] == low)))


class _Verified:
    """Runs of proposed periods, each decided once by comparing words."""

    def __init__(self, x: np.ndarray):
        self.x, self.found, self.known = x, [], {}

    def _reach(self, at: int, q: int) -> int:
        """End of the words from ``at`` on that equal those ``q`` places on."""
        size, x, stop = 32, self.x, len(self.x) - q
        while at < stop:
            differs = x[at : min(at + size, stop)] != x[at + q : min(at + size, stop) + q]
            first = int(differs.argmax())
            if differs[first]:
                return at + first
            at, size = at + len(differs), min(2 * size, 1 << 16)
        return at

    def _back(self, at: int, q: int) -> int:
        size, x = 32, self.x
        while at > 0:
            low = max(0, at - size)
            differs = (x[low:at] != x[low + q : at + q])[::-1]
            first = int(differs.argmax())
            if differs[first]:
                return at - first
            at, size = low, min(2 * size, 1 << 16)
        return at

    def add(self, at: np.ndarray, period: np.ndarray) -> None:
        order = np.lexsort((at, period))
        for i, q in zip(at[order].tolist(), period[order].tolist(), strict=True):
            if i < self.known.get(q, (0, 0))[1] and i >= self.known[q][0]:
                continue
            end, begin = self._reach(i, q), self._back(i, q)
            self.known[q] = (begin, end)
            if end - begin >= q:
                self.found.append((begin, end + q, q))

    def runs(self) -> Runs:
        rows = np.array(self.found, np.int64).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def _neighbouring_regions(x: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Proposals (position, period) from regions of one period that overlap by less than it and fall in the same order."""
    begin, end, period = runs
    kept = end - begin >= np.maximum(3 * period, SMALL)
    order = np.lexsort((begin[kept], period[kept]))
    begin, end, period = begin[kept][order], end[kept][order], period[kept][order]
    at, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # the first word after a region tells whether the next one, which must hold it, can be a neighbour
    near = np.flatnonzero((period[1:] == period[:-1]) & (begin[1:] <= end[:-1]))
    for i in near.tolist():
        p, b1, e1, b2, e2 = int(period[i]), int(begin[i]), int(end[i]), int(begin[i + 1]), int(end[i + 1])
        last = x[e1 - p : e1]
        turn = next((c for c in range(p) if np.array_equal(x[b2 + c : b2 + c + p], last)), None)
        if turn is None:
            continue
        shift = (b2 + turn - (e1 - p)) % p
        longest = min(e1 - b1, e2 - b2)
        low = SMALL + 1 + (shift - SMALL - 1) % p
        q = np.arange(low, longest + 1, p, dtype=np.int64)
        q = q[e1 - q >= 0]
        at.append(e1 - q)
        size.append(q)
    return np.concatenate(at), np.concatenate(size)


def find_runs(x: np.ndarray, ends: np.ndarray) -> Runs:
    """(begin, end, period) of all runs of the texts that ``x`` holds end to end.

    ``ends`` are the places of their last numbers; each of those must occur nowhere else.
    """
    runs = _small_periods(x)
    sizes = np.diff(ends, prepend=-1)
    place = np.arange(len(x))
    names = mix(mix(x.astype(np.uint64)) + np.uint64(len(x)))  # windows of one word
    for width in (1, 2):
        names = _doubled(names, width)
    scale, verified = FIRST_SCALE, _Verified(x)
    while True:
        large = sizes > 2 * (3 * scale - 1)
        if not large.any():
            break
        if not large.all():  # shorter texts have no run of this scale or a larger one
            stay = np.repeat(large, sizes)
            place, names = place[stay], names[stay[: len(names)]]
            sizes = sizes[large]
        begin, end, period = runs
        dense = (3 * period <= scale) & (end - begin >= scale)
        periodic = _inside(begin[dense], end[dense] - scale + 1, len(x))[place[: len(names)]]
        kept = synchronising_set(names, periodic, scale)
        names = _doubled(names, scale)
        kept = kept[kept < len(names)]
        context, where = names[kept], place[kept]
        order = np.lexsort((where, context))
        context, where = context[order], where[order]
        lag = 1
        while lag < len(where):
            gap = where[lag:] - where[:-lag]
            near = (context[lag:] == context[:-lag]) & (gap < 6 * scale - 1)
            if not near.any():
                break
            proposed = near & (gap >= 3 * scale - 1)
            verified.add(where[:-lag][proposed], gap[proposed])
            lag += 1
        runs = _smallest(_joined([runs, verified.runs()]))
        verified.found.clear()
        scale *= 2
    verified.add(*_neighbouring_regions(x, runs))
    return _smallest(_joined([runs, verified.runs()]))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of windows twice as long as those of ``width`` words."""
    return mix(names[:-width] * _STEP + names[width:]) if len(names) > width else names[:0]


def _unchanged(words: list[bytes], doc_id: int | None) -> list[bytes]:
    return words


def _described(part: pa.RecordBatch, text: str, prepare: Callable[[list[bytes], int | None], list[bytes]]) -> list[pa.Array]:
    """The new columns of the rows of one piece."""
    texts = part[text].cast(pa.large_binary()).to_pylist()
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [prepare((t or b"").split(), i) for t, i in zip(texts, part["doc_id"].to_pylist(), strict=True)]
    del texts
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.append(0, np.cumsum(sizes + 1))
    x = np.empty(first[-1], np.int64)
    for i, w in enumerate(words):
        x[first[i] : first[i] + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
        x[first[i] + len(w)] = -1 - i
    begin, end, period = find_runs(x, first[1:] - 1)
    reported = end - begin >= np.maximum(12, 2 * period)
    begin, end, period = begin[reported], end[reported], period[reported]
    order = np.lexsort((period, begin))
    begin, end, period = begin[order], end[order], period[order]
    dropped = _inside(begin + period, end, len(x))
    owner = np.searchsorted(first, begin, "right") - 1
    lo, hi = np.searchsorted(owner, [np.arange(len(words)), np.arange(1, len(words) + 1)])
    rows = []
    for i, w in enumerate(words):
        at = first[i]
        if lo[i] == hi[i]:
            rows.append((0, None, None, None, None, hashlib.sha256().hexdigest(), *_collapsed(w)))
            continue
        mine = slice(lo[i], hi[i])
        b, length, q = begin[mine] - at, end[mine] - begin[mine], period[mine]
        best = np.lexsort((q, b, -length))[0]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(b.tolist(), length.tolist(), q.tolist(), strict=True))
        kept = np.flatnonzero(~dropped[at : at + len(w)]).tolist()
        rows.append((
            len(b), int(b[best]), int(length[best]), int(q[best]), int(1000 * length[best] // q[best]),
            hashlib.sha256(lines.encode()).hexdigest(), *_collapsed([w[k] for k in kept]),
        ))
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(NEW.values())]


def _collapsed(words: list[bytes]) -> tuple[str, str]:
    left = b" ".join(words)
    return hashlib.sha256(left).hexdigest(), left.decode()


def periodic_runs(
    docs: DataFrame, text: str = "text", prepare: Callable[[list[bytes], int | None], list[bytes]] = _unchanged, keep_text: bool = True
) -> DataFrame:
    """``docs`` (doc_id, ``text``, ...) with the number of runs of at least 12 words, the longest one (ties: smallest start,
    then period; four nulls without runs), digests of all runs and of the kept words, and, with ``keep_text``, those words
    joined by one space. A word goes if a run holds it after that run's first period.

    ``prepare`` may put other words in place of a text's own.
    """
    new = [c for c in NEW if keep_text or c != "collapsed_text"]
    kept = docs.drop(*new)
    out = [c for c in kept.columns if keep_text or c != text]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, text, PIECE):
                made = _described(part, text, prepare)[: len(new)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in out), *made], [*out, *new])

    schema = StructType([*(kept.schema[c] for c in out), *(StructField(c, LongType() if NEW[c] == pa.int64() else StringType()) for c in new)])
    return kept.mapInArrow(batches, schema)


def _with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document by crc32 of its id, made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11(docs: DataFrame) -> DataFrame:
    """Rows of the query. A null doc_id has no crc32, so its words stay."""
    return periodic_runs(docs.select("doc_id", "text"), prepare=_with_planted_run, keep_text=False)
