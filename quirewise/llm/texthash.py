"""Vectorised hashing of words and word n-grams, straight from Arrow text buffers.

A word is a maximal run of bytes other than the six ASCII white-space bytes, with A-Z lower-cased.
Memory is bounded by the Arrow batch: buffers are worked through in blocks cut at white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offsets of each text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about BLOCK_BYTES that end at white space or at the end of a text."""
    at, n = 0, len(data)
    while at < n:
        end = at + BLOCK_BYTES
        if end >= n:
            end = n
        else:
            while True:
                span = np.flatnonzero(_SPACE[data[end : end + 65536]])
                edge = offsets[np.searchsorted(offsets, end)]
                stop = min(end + span[0] if len(span) else n, edge)
                if len(span) or stop < n or end + 65536 >= n:
                    end = int(stop)
                    break
                end += 65536
        yield at, end
        at = end


def hashed_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts in order, and the n + 1 offsets of each text's words."""
    data, offsets = text_bytes(texts)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _blocks(data, offsets):
        part = data[a:b]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [a, b])
        edges = offsets[lo:hi] - a
        edges = edges[edges < len(part)]
        first[edges] |= inside[edges]
        where = np.flatnonzero(first)
        if not len(where):
            continue
        kept = np.flatnonzero(inside)
        word = np.cumsum(first)[kept] - 1
        place = kept - where[word]
        value = (_LOWER[part[kept]] + np.uint64(1)) * _POWERS[place & 4095]
        far = np.flatnonzero(place > 4095)  # every block of a longer word has a factor of its own
        value[far] *= mix((place[far] >> 12).astype(np.uint64)) | np.uint64(1)
        begin = np.flatnonzero(first[kept])
        length = np.diff(np.append(begin, len(kept))).astype(np.uint64)
        hashes.append(mix(np.add.reduceat(value, begin) + length))
        starts.append(where + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (over text borders too: the caller cuts by text)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        h = h * _BASE + words[i : len(words) - width + 1 + i]
    return mix(h)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashed shingles of each text.

    A text of fewer than ``width`` words has its whole sequence as one shingle; without words, none.
    """
    words, at = hashed_words(texts)
    grams = window_hashes(words, width)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
