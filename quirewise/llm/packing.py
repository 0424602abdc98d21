"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents longer than a sequence are cut into pieces of the sequence length, the first of which takes the rest. Full pieces are
sequences of their own. The others are dealt into blocks of a few thousand pieces by a hash, and each block is packed by
islands: a population of packings each, improved over generations. A crossover injects whole well-filled bins of
one packing into another, drops the bins that hold duplicates of the injected pieces and some of the worst filled, and
best-fits the displaced pieces: the last one or two of a bin are those that leave least free. After each epoch the best
packing of an island replaces the worst of the next. Epochs go on while a block is over its lower bound and the epoch before
saved a sequence, EPOCHS at most. The best packing of a block's islands gives its sequences.

A block is bounded, so is every task; the number of blocks grows with the pieces and costs at most about one sequence each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, materialize

SEQUENCE = 2048
#: Pieces of a block, islands of a block, packings of an island, most epochs, crossovers without gain that end an epoch.
BLOCK_PIECES, ISLANDS, POPULATION, EPOCHS, PATIENCE = 4096, 2, 4, 4, 10
#: Islands that one task evolves in turn on large inputs.
ISLANDS_A_TASK = 32
TOKENIZER = "byte_bpe_50k.json"
#: Encoded words a worker keeps, in about 400 bytes each; when full it starts again.
CACHE_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class WordEncoder:
    """Token ids of texts under a byte-level BPE file, word by word with a bounded cache.

    The file's own pattern never joins a word to the space before the next one, so a text splits at each space
    that a non-space follows, and the parts can be encoded alone. Texts that hold a special token's string go through the file's
    tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        to_byte = _byte_letters()
        ranks = {bytes(to_byte[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``; KeyError where the word may belong to the white space before it."""
        if not word or word[0].isspace():
            raise KeyError(word)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids = np.array(self.words.encode_ordinary(" " + word), np.uint32).tobytes()
        self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        first, *words = text.split(" ")
        get, make = self.cache.get, self._word
        try:
            rest = [get(w) or make(w) for w in words]
        except KeyError:  # runs of white space: cut at single spaces before a word only
            first, *words = re.split(r" (?=\S)", text)
            rest = [get(w) or make(w) for w in words]
        return b"".join([np.array(self.words.encode_ordinary(first), np.uint32).tobytes(), *rest])


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """PIECES of every row of ``docs`` (doc_id, text): its ids and a closing id 0, cut only if over ``capacity``.

    Null texts are empty, that is the closing id alone.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    bound_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(*(batch[c].slice(at, 256).to_pylist() for c in ("doc_id", "text")), strict=True):
                    ids = encoder.encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = ids[4 * a : 4 * b]
                        rows.append((doc, piece, a, b - a, zlib.crc32(part), part))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class BestFit:
    """Bins by their free space, for best fit in constant time a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.by_free = capacity, [[] for _ in range(capacity + 1)]
        self.open = 0  # bit f is set while some bin has f free

    def put(self, bin_: list[int], free: int) -> None:
        self.by_free[free].append(bin_)
        self.open |= 1 << free

    def fit(self, piece: int, length: int) -> None:
        """Put a piece into the fullest bin that holds it, or a new one."""
        fitting = self.open >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bins = self.by_free[free]
            bin_ = bins.pop()
            if not bins:
                self.open &= ~(1 << free)
        else:
            free, bin_ = self.capacity, []
        bin_.append(piece)
        self.put(bin_, free - length)

    def bins(self) -> list[list[int]]:
        return [b for bins in self.by_free for b in bins]


Packing = list[list[int]]


def _packed(order: list[int], length: list[int], capacity: int, kept: Packing = ()) -> Packing:
    fit = BestFit(capacity)
    for bin_ in kept:
        fit.put(list(bin_), capacity - sum(length[i] for i in bin_))
    for i in order:
        fit.fit(i, length[i])
    return fit.bins()


class Stock:
    """Displaced pieces by length, and the lengths in stock as bits: which two fill a gap exactly is one AND of two bit strings."""

    def __init__(self, pieces: list[int], length: list[int], capacity: int):
        self.capacity, self.by_length = capacity, {}
        for i in pieces:
            self.by_length.setdefault(length[i], []).append(i)
        self.have = sum(1 << n for n in self.by_length)
        self.mirror = sum(1 << (capacity - n) for n in self.by_length)

    def take(self, n: int) -> int:
        pieces = self.by_length[n]
        out = pieces.pop()
        if not pieces:
            del self.by_length[n]
            self.have ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)
        return out

    def largest(self, most: int) -> int:
        """The greatest length in stock of at most ``most``, or 0."""
        return max(0, (self.have & ((2 << most) - 1)).bit_length() - 1)

    def pair(self, total: int, near: int) -> tuple[int, int] | None:
        """Two lengths in stock that make ``total``, the larger one at ``near`` or as little below it as can be."""
        both = self.have & (self.mirror >> (self.capacity - total))
        if total % 2 == 0 and both >> (total // 2) & 1 and len(self.by_length[total // 2]) < 2:
            both ^= 1 << (total // 2)
        if not both:
            return None
        at = (both & ((2 << near) - 1)).bit_length() - 1
        if 2 * at < total:
            at = both.bit_length() - 1
        return at, total - at


#: Free places up to which two pieces are looked for before one that fits alone is taken.
SLACK = 24


def best_fit_pairs(pieces: list[int], length: list[int], capacity: int, random: np.random.Generator) -> Packing:
    """Bins of ``pieces``: each opens with the largest left, takes large ones while two cannot fill it, and ends with
    the one or two pieces that leave least free."""
    stock, out = Stock(pieces, length, capacity), []
    while stock.have:
        n = stock.largest(capacity)
        bin_, free = [stock.take(n)], capacity - n
        while stock.have and (top := stock.largest(free)):
            if free > 2 * top:  # two will not do
                bin_.append(stock.take(top))
                free -= top
                continue
            found = None
            for waste in range(min(SLACK, free - top, free)):
                found = stock.pair(free - waste, int(random.integers((free - waste + 1) // 2, free - waste + 1)))
                if found:
                    break
            if not found:
                bin_.append(stock.take(top))
                free -= top
                continue
            bin_.extend(stock.take(x) for x in found)
            free -= sum(found)
        out.append(bin_)
    return out


def fitness(packing: Packing, length: list[int], capacity: int) -> float:
    """Fewer bins first; of equal numbers, the more unevenly filled, which leaves more room to improve."""
    return float(np.mean([(sum(length[i] for i in b) / capacity) ** 2 for b in packing])) - len(packing)


def crossover(a: Packing, b: Packing, length: list[int], capacity: int, random: np.random.Generator) -> Packing:
    """``a`` with a share of the best-filled bins of ``b`` injected whole.

    Bins of ``a`` that hold a piece injected go, and so does a share of its worst-filled ones. What they displace is packed
    best fit: what two or fewer pieces complete in bins of their own, and the worst of those into gaps anywhere.
    """
    fill = np.array([sum(length[i] for i in x) for x in b])
    chance = random.random(len(b)) * 0.02 + fill / capacity
    injected = [b[i] for i in np.argsort(-chance)[: max(1, int(len(b) * random.uniform(0.2, 0.6)))]]
    taken = {i for x in injected for i in x}
    own = np.array([sum(length[i] for i in x) for x in a])
    poor = np.zeros(len(a), bool)
    poor[np.argsort(own + random.random(len(a)))[: max(1, int(len(a) * random.uniform(0.05, 0.4)))]] = True
    kept, displaced = list(injected), []
    for x, bad in zip(a, poor, strict=True):
        if not bad and taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced.extend(i for i in x if i not in taken)
    made = best_fit_pairs(displaced, length, capacity, random)
    made.sort(key=lambda x: -sum(length[i] for i in x))
    last = [i for x in made[len(made) * 9 // 10 :] for i in x]
    return _packed(sorted(last, key=lambda i: -length[i]), length, capacity, kept + made[: len(made) * 9 // 10])


def least_bins(length: list[int], capacity: int) -> int:
    """No packing has fewer bins: all that fits, and one for each piece over half."""
    return max(-(-sum(length) // capacity), sum(2 * n > capacity for n in length))


def evolve(population: list[Packing], length: list[int], capacity: int, patience: int, random: np.random.Generator) -> list[Packing]:
    """Best first. Each crossover of two packings replaces the worst one if it is better.

    Stops at the least possible number of bins, or when ``patience`` crossovers in a row saved no bin.
    """
    scores = [fitness(p, length, capacity) for p in population]
    least, idle = least_bins(length, capacity), 0
    while idle < patience and len(population) > 1 and (fewest := min(map(len, population))) > least:
        i, j = random.choice(len(population), 2, replace=False)
        child = crossover(population[i], population[j], length, capacity, random)
        score, worst = fitness(child, length, capacity), int(np.argmin(scores))
        if score > scores[worst]:
            population[worst], scores[worst] = child, score
        idle = 0 if len(child) < fewest else idle + 1
    return [population[i] for i in np.argsort(scores)[::-1]]


def _start(length: list[int], capacity: int, count: int, random: np.random.Generator) -> list[Packing]:
    """Best fit of the pieces, largest first: exactly, then with lengths blurred by up to a tenth."""
    size = np.array(length)
    orders = [np.argsort(-size, kind="stable"), *(np.argsort(-size * random.uniform(0.9, 1.0, len(size))) for _ in range(count - 1))]
    return [_packed(o.tolist(), length, capacity) for o in orders]


def _coded(packing: Packing, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for number, bin_ in enumerate(packing):
        out[bin_] = number
    return out.tobytes()


def _decoded(code: bytes) -> Packing:
    bins = np.frombuffer(code, np.int32)
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]


ISLAND = "block long, island int, place int, lengths binary, code binary, score double, bins int, first_bins int, least int"


def _epoch(number: int, capacity: int, population: int, patience: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Evolve one island: its packings, or (in epoch 0) those it starts with, whose fewest bins are first_bins."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        length = np.frombuffer(frame["lengths"].iloc[0], np.int32).tolist()
        random = np.random.default_rng([block & 0xFFFFFFFF, island, number])
        if number == 0:
            packings = _start(length, capacity, population, random)
            first = min(map(len, packings))
        else:
            packings, first = [_decoded(c) for c in frame.sort_values("place")["code"]], int(frame["first_bins"].min())
        packings = evolve(packings, length, capacity, patience, random)
        return pd.DataFrame({
            "block": block, "island": island, "place": range(len(packings)), "lengths": [frame["lengths"].iloc[0]] * len(packings),
            "code": [_coded(p, len(length)) for p in packings], "score": [fitness(p, length, capacity) for p in packings],
            "bins": [len(p) for p in packings], "first_bins": first, "least": least_bins(length, capacity),
        })

    return run


def evolved_blocks(packed: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """(block, code, bins, first_bins, least) of the written blocks (block, lengths): the best packing, its number of
    bins, the fewest of the start populations, and the lower bound."""
    tasks = min(blocks * ISLANDS, max(2 * packed.sparkSession.sparkContext.defaultParallelism, blocks * ISLANDS // ISLANDS_A_TASK))
    islands = packed.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("place"), "lengths",
        F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("score"), F.lit(0).alias("first_bins"),
    )
    done, before = None, None
    for number in range(EPOCHS):
        # much work for few bytes: a fixed number of partitions, which adaptive execution does not merge
        groups = islands.repartition(tasks, "block", "island").groupBy("block", "island")
        islands = materialize(groups.applyInPandas(_epoch(number, capacity, POPULATION, PATIENCE), ISLAND), "islands")
        best = islands.groupBy("block").agg(
            F.min_by(F.struct("island", "place", "bins", "least"), F.struct("bins", -F.col("score"), "island", "place")).alias("best"),
            F.min("first_bins").alias("first_bins"),
        ).select("block", "first_bins", "best.*")
        found = islands.select("block", "island", "place", "code").join(best, ["block", "island", "place"])
        best = materialize(found.select("block", "code", "bins", "first_bins", "least"), "islands-best")
        # blocks at their bound, or without gain since the epoch before, are done
        over = best.withColumn("last_bins", F.col("first_bins"))
        if before is not None:
            over = best.join(before.select("block", F.col("bins").alias("last_bins")), "block")
        over = over.filter("bins > least and bins < last_bins").select("block")
        done = best if done is None else done.join(best, "block", "left_anti").unionByName(best)
        if number == EPOCHS - 1 or over.isEmpty():
            break
        before, islands = best, islands.join(over, "block", "left_semi")
        # the best of an island takes the place of the worst of the next
        elite = islands.filter("place = 0").withColumns({"island": ((F.col("island") + 1) % ISLANDS).cast("int"), "place": F.lit(POPULATION - 1)})
        islands = islands.filter(F.col("place") < POPULATION - 1).unionByName(elite)
    return done


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``pieces`` (any columns, with a ``length`` of at most ``capacity``) and sequence_id, offset.

    ``pieces`` must be a written table with a column ``place`` that no two rows share. Full pieces are sequences
    alone. Equal lengths and repeated rows are told apart by ``place``.
    """
    short = pieces.filter(F.col("length") < capacity)
    count = short.count()
    blocks = max(1, -(-count // BLOCK_PIECES))
    dealt = short.select("place", "length", F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"))

    def lengths(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({
            "block": frame["block"].iloc[:1], "places": [frame["place"].to_numpy(np.int64).tobytes()],
            "lengths": [frame["length"].to_numpy(np.int32).tobytes()],
        })

    packed = materialize(dealt.groupBy("block").applyInPandas(lengths, "block long, places binary, lengths binary"), "packing-blocks")
    best = evolved_blocks(packed, blocks, capacity)

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, places, sizes, code in zip(frame["block"], frame["places"], frame["lengths"], frame["code"], strict=True):
            place, size, bins = np.frombuffer(places, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(code, np.int32)
            order = np.argsort(bins, kind="stable")
            upto = np.cumsum(size[order]) - size[order]
            lead = np.append(True, np.diff(bins[order]) != 0)
            offset = upto - upto[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
            out.append(pd.DataFrame({"place": place[order], "sequence_id": (int(block) << 20) + bins[order], "offset": offset}))
        return pd.concat(out)

    found = packed.join(best, "block").groupBy("block").applyInPandas(assign, "place long, sequence_id long, offset long")
    return (
        pieces.filter(F.col("length") < capacity).join(found, "place")
        .unionByName(pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("place"), "offset": F.lit(0).cast("long")}))
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """Rows of PIECES without ids, and sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, capacity).drop("ids").withColumn("place", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), capacity).drop("place")


def op7(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
