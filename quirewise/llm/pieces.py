"""SentencePiece BPE encoding and decoding, giant documents as a max-plus scan over chunks.

A text is BPE encoded by pieces t1..tn exactly if each piece encodes to itself and each neighbouring pair encodes to itself. So
the encoding is the one path of score 0 through the lattice of pieces in which such pairs score 0 and all others minus
infinity, and it can be found piecewise:

1. A document longer than a chunk is cut every CHUNK_CHARS characters, anywhere. The state at a cut is the piece that ends at it or
   stretches over it: (characters before the cut, characters after it).
2. Each chunk alone gives the max-plus transfer matrix from the states at its start to those at its end. Between the first and
   the last place where no piece can reach over (before a space after a non-space, around a character that
   has no piece) all paths meet, so only the two ends of a chunk need the lattice; a chunk without such a place is one lattice.
3. The matrices of a document are combined associatively in a tree, and the states at all cuts follow.
4. Each chunk is backtraced on its own from its two states.

Whole words between such places are encoded once each and kept in a bounded cache. Decoding turns pieces back chunk by chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
CACHE_WORDS = 500_000
#: Chunks of whole documents whose products one task combines on large inputs.
CHUNKS_A_TASK = 4096
SPACE = "▁"
#: A state is written as before * STATES + after.
STATES = 32
START = 0


class PieceModel:
    """A SentencePiece BPE model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        library = self.library
        self.pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if library.is_byte(i)}
        special = [library.is_byte(i) or library.is_control(i) or library.is_unknown(i) for i in range(len(self.pieces))]
        self.score = {p: library.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.number = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.longest = max(map(len, self.number))
        self.heads = {p[:n] for p in self.number for n in range(1, len(p) + 1)}
        if self.longest >= STATES or any(SPACE in p.lstrip(SPACE) for p in self.number):
            raise ValueError("pieces of this model are too long or reach over spaces")
        values = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [values.get(i, b"" if special[i] else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.words: dict[str, bytes] = {}
        self.pair_fits = lru_cache(200_000)(lambda a, b: self._merged(a + b) == [a, b])
        self.stands = lru_cache(100_000)(lambda a: a in self.number and self._merged(a) == [a])

    def _merged(self, text: str) -> list[str]:
        """BPE by definition: the best-scored neighbouring pair merges, the first of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in self.score]
            if not found:
                break
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def ids_of(self, piece: str) -> list[int]:
        return [self.number[piece]] if piece in self.number else [self.byte[b] for b in piece.encode()]

    def word(self, word: str) -> bytes:
        """Ids of a space and ``word``; KeyError for an empty one, which stands for one of several spaces."""
        if not word:
            raise KeyError(word)
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        ids = self.words[word] = np.array(self.library.encode(word), np.uint32).tobytes()
        return ids

    def closed(self, text: str) -> bytes:
        """Ids of text that begins with a space (as ``SPACE``) at a place that no piece reaches over, and ends at one."""
        words = text.split(SPACE)
        get, make = self.words.get, self.word
        try:
            return b"".join([get(w) or make(w) for w in words[1:]])
        except KeyError:
            words = re.findall(f"{SPACE}({SPACE}*[^{SPACE}]*)", text)
            return b"".join([get(w) or self.word(w) if w else self._blank for w in words])

    @property
    def _blank(self) -> bytes:
        return np.array(self.ids_of(SPACE), np.uint32).tobytes()

    def lattice(self, text: str, at: int, last: str, end: int) -> dict[int, tuple[int, str]]:
        """Position -> (begin, piece) of the only piece that can end there, walking from ``at`` after the piece ``last``.

        Positions from ``end`` on are not left again.
        """
        reached = {at: (at - len(last), last)}
        for place in range(at, end):
            if place not in reached:
                continue
            before = reached[place][1]
            if text[place] not in self.number:
                reached[place + 1] = (place, text[place])
                continue
            for piece in self.standing(text, place):
                if before not in self.number or self.pair_fits(before, piece):
                    reached[place + len(piece)] = (place, piece)
        return reached

    def standing(self, text: str, place: int) -> Iterator[str]:
        """Pieces that begin at ``place`` and encode to themselves."""
        for size in range(1, min(self.longest, len(text) - place) + 1):
            piece = text[place : place + size]
            if piece not in self.heads:
                return
            if self.stands(piece):
                yield piece

    def walk(self, text: str, starts: list[tuple[int, int]], end: int) -> dict[int, dict[int, int]]:
        """Position from ``end`` on -> begin of a piece that ends there -> bits of the ``starts`` (begin and end of a
        piece) that lead to it. What follows a piece does not depend on how it was reached, so paths that meet go on as one.
        """
        reached: dict[int, dict[int, int]] = {}
        for i, (begin, place) in enumerate(starts):
            reached.setdefault(place, {})[begin] = 1 << i
        for place in range(min(reached, default=end), end):
            ways = reached.pop(place, None)
            if not ways:
                continue
            before = [(text[begin:place], bits) for begin, bits in ways.items()]
            if text[place] not in self.number:
                steps = [(text[place], _any(ways.values()))]
            else:
                steps = [
                    (piece, _any(bits for last, bits in before if last not in self.number or self.pair_fits(last, piece)))
                    for piece in self.standing(text, place)
                ]
            for piece, bits in steps:
                if bits:
                    reached.setdefault(place + len(piece), {})[place] = bits
        return reached


def _any(bits: Iterable[int]) -> int:
    return reduce(or_, bits, 0)


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _edges(model: PieceModel, text: str, begin: int, end: int) -> tuple[int, int] | None:
    """First and last place in ``begin``..``end`` before a space that follows a non-space."""
    first = last = None
    for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text[max(0, begin - 1) : end]):
        place = m.start() + max(0, begin - 1)
        if place >= begin:
            first = place
            break
    if first is None:
        return None
    last = end
    while not (text[last - 1] == SPACE and last - 2 >= 0 and text[last - 2] != SPACE):
        last -= 1
    return first, last - 1


def _entries(model: PieceModel, text: str, at: int) -> list[tuple[int, int]]:
    """States at a cut: pieces that end at it or stretch over it."""
    out = []
    for before in range(1, min(model.longest, at) + 1):
        for after in range(0, model.longest - before + 1):
            piece = text[at - before : at + after]
            if len(piece) == before + after and (model.stands(piece) or (piece not in model.number and before + after == 1)):
                out.append((before, after))
    return out


def _exits(reached: dict[int, tuple[int, str]], end: int) -> list[tuple[int, int]]:
    return [(end - begin, place - end) for place, (begin, _) in reached.items() if place >= end and begin < end]


def transfer(model: PieceModel, text: str, begin: int, end: int, first: bool) -> np.ndarray:
    """Transfer matrix of text[begin:end] as rows (state in, state out) of score 0; all others are minus infinity.

    ``text`` holds at least a piece's length more on both sides where the document goes on.
    """
    entries = [(0, 0)] if first else _entries(model, text, begin)
    edges = _edges(model, text, begin + model.longest, end - 1) if end - begin > 2 * model.longest else None
    pairs = []
    reached = model.walk(text, [(begin - before, begin + after) for before, after in entries], end if edges is None else edges[0])
    if edges is None:
        ends = [((end - at, place - end), bits) for place, ways in reached.items() for at, bits in ways.items() if at < end]
    else:
        bits = _any(reached.get(edges[0], {}).values())
        ends = [(out, bits) for out in _exits(model.lattice(text, edges[1], "", end), end)]
    for (b, a), bits in ends:
        pairs += [(before * STATES + after, b * STATES + a) for i, (before, after) in enumerate(entries) if bits >> i & 1]
    return np.array(pairs, np.int32).reshape(-1, 2)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two such matrices: pairs that meet in a middle state."""
    inner: dict[int, list[int]] = {}
    for i, o in b.tolist():
        inner.setdefault(i, []).append(o)
    pairs = {(i, o) for i, m in a.tolist() for o in inner.get(m, ())}
    return np.array(sorted(pairs), np.int32).reshape(-1, 2)


def scan(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States at all cuts, ``start`` and ``end`` included, by a tree of associative products."""
    if len(matrices) == 1:
        return [start, end]
    middle = len(matrices) // 2
    left, right = _folded(matrices[:middle]), _folded(matrices[middle:])
    meet = {o for i, o in left.tolist() if i == start} & {i for i, o in right.tolist() if o == end}
    if len(meet) != 1:
        raise ValueError(f"{len(meet)} states at a cut")
    state = meet.pop()
    return scan(matrices[:middle], start, state)[:-1] + scan(matrices[middle:], state, end)


def _folded(matrices: list[np.ndarray]) -> np.ndarray:
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def backtrace(model: PieceModel, text: str, begin: int, end: int, state_in: int, state_out: int) -> bytes:
    """Ids of the pieces that begin in text[begin:end], given the states at both ends."""
    before, after = divmod(state_in, STATES)
    out_before, out_after = divmod(state_out, STATES)
    at, last = begin + after, text[begin - before : begin + after]
    edges = _edges(model, text, begin + model.longest, end - 1) if end - begin > 2 * model.longest else None
    if edges is None:
        return _path(model, model.lattice(text, at, last, end), at, end + out_after)
    head = _path(model, model.lattice(text, at, last, edges[0]), at, edges[0])
    tail = _path(model, model.lattice(text, edges[1], "", end), edges[1], end + out_after)
    return head + model.closed(text[edges[0] : edges[1]]) + tail


def _path(model: PieceModel, reached: dict[int, tuple[int, str]], begin: int, place: int) -> bytes:
    pieces = []
    while place > begin:
        place, piece = reached[place]
        pieces.append(piece)
    return np.array([i for p in reversed(pieces) for i in model.ids_of(p)], np.uint32).tobytes()


def _spaced(text: str) -> str:
    """The text as pieces see it: spaces written as ``SPACE``, one in front; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def decode(model: PieceModel, ids: np.ndarray) -> bytes:
    """UTF-8 of ids, the leading space included."""
    table = model.bytes
    return b"".join([table[i] for i in ids.tolist()])


CHUNKS = "row long, doc_id long, chunk int, chunks int, begin int, end int, body string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ENCODED = "doc_id long, n_ids long, ids binary, decoded string"


def encode(docs: DataFrame, model: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_ids, ids, decoded) of every row of ``docs`` (doc_id, text): ids are little-endian unsigned 32-bit.

    The ids are those the SentencePiece library gives for the whole text. Null texts are empty and have no ids. Decoding
    gives the text back, but for characters U+2581, which come back as spaces.
    """
    path = model or public_tokenizers.path(MODEL)
    docs = docs.select("doc_id", "text")
    short = F.coalesce(F.length("text"), F.lit(0)) < chunk_chars

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, text in zip(*(batch[c].slice(at, 512).to_pylist() for c in ("doc_id", "text")), strict=True):
                    ids = np.frombuffer(m.closed(_spaced(text or "")), np.uint32)
                    rows.append((doc, len(ids), ids.tobytes(), decode(m, ids)[1:].decode()))
                yield _batch(rows, ENCODED)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = STATES
        for batch in it:
            for row, doc, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                text = _spaced(text)
                cuts = [*range(0, len(text), chunk_chars), len(text)]
                if len(cuts) > 2 and cuts[-1] - cuts[-2] < 4 * margin:
                    del cuts[-2]
                for i in range(0, len(cuts) - 1, 64):
                    yield _batch([
                        (row, doc, n, len(cuts) - 1, min(cuts[n], margin), min(cuts[n], margin) + cuts[n + 1] - cuts[n], text[max(0, cuts[n] - margin) : cuts[n + 1] + margin])
                        for n in range(i, min(i + 64, len(cuts) - 1))
                    ], CHUNKS)

    def transfers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in it:
            rows = [
                (row, chunk, chunks, transfer(m, body, begin, end, chunk == 0).tobytes())
                for row, chunk, chunks, begin, end, body in zip(*(batch[c].to_pylist() for c in ("row", "chunk", "chunks", "begin", "end", "body")), strict=True)
            ]
            yield _batch(rows, "row long, chunk int, chunks int, matrix binary")

    def scanned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        matrices = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in frame["matrix"]]
        ends = {o for _, o in matrices[-1].tolist() if o % STATES == 0}
        total = _folded(matrices)
        end = [o for i, o in total.tolist() if i == START and o in ends]
        if len(end) != 1:
            raise ValueError(f"{len(end)} states at the end of a text")
        states = scan(matrices, START, end[0])
        return pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "state_in": states[:-1], "state_out": states[1:]})

    def traced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in it:
            rows = []
            for row, doc, chunk, begin, end, body, i, o in zip(
                *(batch[c].to_pylist() for c in ("row", "doc_id", "chunk", "begin", "end", "body", "state_in", "state_out")), strict=True
            ):
                ids = backtrace(m, body, begin, end, i, o)
                rows.append((row, doc, chunk, ids, decode(m, np.frombuffer(ids, np.uint32))))
            yield _batch(rows, "row long, doc_id long, chunk int, ids binary, decoded binary")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        ids, text = b"".join(frame["ids"]), b"".join(frame["decoded"])[1:]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "n_ids": [len(ids) // 4], "ids": [ids], "decoded": [text.decode()]})

    numbered = docs.filter(~short).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = materialize(numbered.mapInArrow(split, CHUNKS), "text-chunks")
    matrices = chunks.mapInArrow(transfers, "row long, chunk int, chunks int, matrix binary")
    # products are much work for few bytes: a number of partitions that adaptive execution does not merge
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, chunks.count() // CHUNKS_A_TASK)
    states = matrices.repartition(tasks, "row").groupBy("row").applyInPandas(scanned, "row long, chunk int, state_in int, state_out int")
    parts = chunks.join(states, ["row", "chunk"]).mapInArrow(traced, "row long, doc_id long, chunk int, ids binary, decoded binary")
    return docs.filter(short).mapInArrow(whole, ENCODED).union(parts.groupBy("row").applyInPandas(joined, ENCODED))


def op10(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, n_ids, ids_sha256 (of the little-endian ids), decoded_sha256, n_chars (decoded)."""
    return encode(docs).select(
        "doc_id", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.length("decoded").cast("long").alias("n_chars"),
    )
