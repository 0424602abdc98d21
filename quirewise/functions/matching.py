"""Which of many texts occur in each row of a table: a join on rare grams, in one scan of the table.

1. Every text asked for is known by a few grams: byte strings of the largest width in WIDTHS that fits its longest part without
   wildcards, spread evenly over it. A text cannot contain the one asked for without containing all of these grams.
2. One scan of the table finds, for each row, which of all those grams it holds. Windows of a row's bytes are named by hashes
   doubled from width to width and tested against a filter of fixed size, whatever the number of grams. The rows that hold any
   are written out with them: the posting table.
3. The posting table tells how often each gram occurs. Each text asked for is joined on its rarest; one of whose
   grams none is found is done with. The pairs left meet the row's text again, and Spark's own test decides.

No text asked for passes the driver, and nothing but the filter is broadcast. What a wrong hit of the filter costs is a row more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Widths of grams in bytes, and how many of them a text is looked up by.
WIDTHS, GRAMS = (16, 8, 4, 2, 1), 4
#: The gram of a text without a fixed byte; every row has it.
EVERYWHERE = 0
#: Bits of the filter; each gram sets two. The driver gets it in words of WORD_BITS.
FILTER_BITS, WORD_BITS = 1 << 26, 1 << 15
PIECE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def anchor(text: str, wildcards: bool) -> str:
    """The longest run of a query free of wildcards; every match must contain it."""
    if not wildcards:
        return text
    return max(re.split("[%_]", text), key=len)


def _spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _named(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, gram at each place) from the narrowest width up."""
    names, width = _spread_bits(data.astype(np.uint64) + _STEP), 1
    while width <= WIDTHS[0] and len(names):
        if width in WIDTHS:
            yield width, np.maximum(_spread_bits(names + np.uint64(width)) & np.uint64((1 << 63) - 1), np.uint64(1))
        names = _spread_bits(names[:-width] * _STEP + names[width:]) if len(names) > width else names[:0]
        width *= 2


def grams_of(text: str, wildcards: bool) -> list[int]:
    """The grams a text is looked up by."""
    data = np.frombuffer(anchor(text, wildcards).encode(), np.uint8)
    if not len(data):
        return [EVERYWHERE]
    width = next(w for w in WIDTHS if w <= len(data))
    found = dict(_named(data))[width]
    return [int(g) for g in found[np.unique(np.linspace(0, len(found) - 1, GRAMS).astype(np.int64))]]


def _bits(gram: Column) -> list[Column]:
    return [F.shiftright(gram, shift).bitwiseAND(F.lit(FILTER_BITS - 1)) for shift in (0, 26)]


def _filter(grams: DataFrame) -> bytes:
    """The filter that all ``grams`` pass: FILTER_BITS in all, whatever their number."""
    place = F.explode(F.array(*_bits(F.col("gram")))).alias("place")
    words = (
        grams.select(place).select(F.bitmap_bucket_number(F.col("place") + 1).alias("word"), F.bitmap_bit_position(F.col("place") + 1).alias("bit"))
        .groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    table = bytearray(FILTER_BITS // 8)
    for row in words.toLocalIterator():
        at = (row["word"] - 1) * WORD_BITS // 8
        table[at : at + WORD_BITS // 8] = row["bits"]
    return bytes(table)


def _held(data: np.ndarray, offsets: np.ndarray, bits: np.ndarray, widths: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram), sorted and each once, of the grams of the rows' bytes that pass the filter."""
    rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64(FILTER_BITS - 1)
    for width, names in _named(data):
        if width not in widths:
            continue
        at = np.arange(len(names))
        for shift in (0, 26):
            place = (names[at] >> np.uint64(shift)) & low
            at = at[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + width <= offsets[row + 1]
        rows.append(row[inside])
        grams.append(names[at[inside]])
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))[: len(row)]
    return row[fresh], gram[fresh]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about PIECE_BYTES of text, their bytes and offsets; nulls are left out."""
    batch = batch.filter(batch[column].is_valid())
    texts = batch[column].cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _with_grams(df: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """The rows of ``df`` that hold grams of ``asked``, with ``_grams``."""
    bits = df.sparkSession.sparkContext.broadcast(_filter(asked))
    widths = {r[0] for r in asked.select("width").distinct().collect()}  # at most one for each of WIDTHS, and 0
    names = [f.name for f in df.schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part, data, offsets in _pieces(batch, column):
                row, gram = _held(data, offsets, table, widths)
                if 0 in widths:
                    row, gram = np.append(row, np.arange(len(part))), np.append(gram, np.full(len(part), EVERYWHERE, np.uint64))
                    order = np.argsort(row, kind="stable")
                    row, gram = row[order], gram[order]
                which, begin = np.unique(row, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(gram.view(np.int64)))
                kept = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*names, "_grams"])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("_grams", T.ArrayType(T.LongType()))]))


def find_contained(
    df: DataFrame, column: str, queries: DataFrame, *, wildcards: bool = False, keep_text: bool = False
) -> DataFrame:
    """Rows of ``df`` with ``query_id, query_text`` added, one for each text of ``queries`` that ``column`` contains.

    ``queries`` is ``(query_id, text)``; fold case on both sides beforehand if it should not matter. With ``wildcards``,
    ``%`` and ``_`` stand for any characters and any one. ``column`` itself is returned only with ``keep_text``.
    """
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("query_text", T.StringType()),
        T.StructField("gram", T.LongType()), T.StructField("width", T.IntegerType()),
    ])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [grams_of(t, wildcards) for t in texts]
            again = pa.array(np.repeat(np.arange(len(texts)), [len(g) for g in found]))
            sizes = [len(anchor(t, wildcards).encode()) for t in texts]
            width = [next((w for w in WIDTHS if w <= n), 0) for n, g in zip(sizes, found, strict=True) for _ in g]
            yield pa.RecordBatch.from_arrays(
                [batch["query_id"].take(again), batch["text"].take(again), pa.array([x for g in found for x in g], pa.int64()), pa.array(width, pa.int32())],
                ["query_id", "query_text", "gram", "width"],
            )

    asked = queries.select("query_id", "text").filter("text is not null").mapInArrow(grams, schema)
    asked = materialize(asked, "asked-grams")
    held = _with_grams(df.withColumn("_row", F.monotonically_increasing_id()), column, asked.select("gram", "width").distinct())
    held = materialize(held, "gram-postings")
    listed = held.select("_row", F.explode("_grams").alias("gram"))
    often = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # a query with a gram that no row holds is in no row: its rarest gram joins with nothing
    rarest = (
        asked.join(often, "gram", "left").groupBy("query_id", "query_text")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("rarest"), F.count("gram").alias("_grams"))
        .select("query_id", "query_text", F.col("rarest.gram").alias("gram"))
    )
    # one row for each row that the same query comes in
    copies = asked.select("query_id", "query_text", "gram").groupBy("query_id", "query_text", "gram").agg(F.count(F.lit(1)).alias("_copies"))
    rarest = rarest.join(copies, ["query_id", "query_text", "gram"])
    pairs = rarest.join(listed, "gram").select("query_id", "query_text", "_copies", "_row")
    text, wanted = F.col(column), F.col("query_text")
    found = F.contains(text, wanted)
    if wildcards:
        found = F.when(wanted.rlike("[%_]"), F.like(text, within(wanted))).otherwise(found)
    kept = [f.name for f in df.schema.fields if keep_text or f.name != column]
    hits = pairs.join(held.drop("_grams"), "_row").filter(found)
    return hits.select(*kept, "query_id", "query_text", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("col")


def within(query: Column) -> Column:
    """The pattern for 'contains'; a backslash stands for itself."""
    return F.concat(F.lit("%"), F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
