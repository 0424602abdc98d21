"""Text search: substring search, batch containment, BM25 ranking, chunking."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.matching import find_contained, within
from ..functions.ranking import QuestionBlock, best_keywords
from ..functions.sizing import spread
from ..functions.streams import SPLIT_ROWS, against_all, pieces
from ..functions.text import words
from ..session import materialize

#: The words of a lowered text: letters and digits, as ``functions.text.words`` cuts them.
WORD = re.compile(r"[^\W_]+")


def keyword_test(content: Column, query: Column) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the query are wildcards."""
    return F.ilike(content, within(query))


def keyword_search(documents: DataFrame, query: str) -> DataFrame:
    return documents.filter(keyword_test(F.col("content"), F.lit(query))).select(
        "id", "title", "content", "file_type", "user_id"
    )


def batch_keyword_search(
    documents: DataFrame, queries: DataFrame, *, doc_id: str, content: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``(query_id, doc_id, <keep>)`` for every query text found in a document, for a table of queries.

    Queries and documents meet in a join on the rarest gram of each query (``functions/matching.py``): one scan of the documents
    for any number of queries. ``like`` on the lowered text, which is what ``ilike`` means, decides.
    """
    found = find_contained(
        spread(documents.select(F.col(doc_id).alias("doc_id"), F.lower(content).alias("_text"), *keep)),
        "_text",
        queries.select("query_id", F.lower("text").alias("text")),
        wildcards=True,
    )
    return found.select("query_id", "doc_id", *keep)


def hits_per_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hit count for every query, zero included."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return queries.select("query_id").join(counts, "query_id", "left").fillna(0, ["hits"])


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), doc_id: str = "doc_id") -> DataFrame:
    """Best ``k`` per query, ties by id. Planned as a group limit ahead of the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(doc_id))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``; a term written twice counts twice."""
    return (
        queries.select("query_id", F.explode(words("text")).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


#: Bits of the filter that words of the questions pass, whatever their number.
WORD_FILTER_BITS = 1 << 23


def _word_filter(terms: DataFrame) -> bytes:
    place = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(WORD_FILTER_BITS - 1)) + 1
    marked = (
        terms.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    table = bytearray(WORD_FILTER_BITS // 8)
    for row in marked.toLocalIterator():  # at most 256 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        table[at : at + 4096] = row["bits"]
    return bytes(table)


def postings(documents: DataFrame, terms: DataFrame, *, doc_id: str, content: str) -> DataFrame:
    """``(doc_id, doc_len, postings)``: a row for each document, with the listed ones of its words and how often it has them.

    Words are counted inside the row, where it lies: nothing is shuffled, and the table does not grow with words that no question
    asks for. Words of ``terms`` are told by a filter of fixed size, so a few others may be listed too.
    """
    texts = spread(documents.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(content, F.lit(""))).alias("_text")))
    bits = documents.sparkSession.sparkContext.broadcast(_word_filter(terms))
    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = T.StructType([texts.schema["doc_id"], T.StructField("doc_len", T.LongType()), T.StructField("postings", T.ArrayType(entry))])
    kind = to_arrow_schema(schema).field("postings").type

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        listed = _Listed(table)
        for batch in (part for whole in batches for part in pieces(whole, "_text")):
            lengths, found = [], []
            for text in batch["_text"].to_pylist():
                words = WORD.findall(text)
                lengths.append(len(words))
                found.append(list(Counter(w for w in words if listed[w]).items()))
            flat = [x for one in found for x in one]
            entries = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.string()), pa.array([c for _, c in flat], pa.int64())], fields=list(kind.value_type))
            at = np.append(0, np.cumsum([len(one) for one in found])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(at), entries).cast(kind)], ["doc_id", "doc_len", "postings"]
            )

    return texts.mapInArrow(count, schema)


class _Listed(dict):
    """Whether a word passes the filter, remembered for up to MAX_KNOWN words."""

    MAX_KNOWN = 200_000

    def __init__(self, table: bytes):
        self.table = table

    def __missing__(self, word: str) -> bool:
        place = zlib.crc32(word.encode()) & (WORD_FILTER_BITS - 1)
        known = bool(self.table[place >> 3] >> (place & 7) & 1)
        if len(self) < self.MAX_KNOWN:
            self[word] = known
        return known


BLOCK_QUESTIONS, BLOCK_WORDS = 1024, 65_536
#: Listed words that a task holds at a time when many questions stream past.
SPLIT_POSTINGS = 1 << 21


def weighted_questions(index: DataFrame, queries: DataFrame, terms: DataFrame) -> tuple[DataFrame, float]:
    """Every question once, written, with ``weights`` (array of ``term, w``: occurrences times inverse document frequency)
    added to its columns, and the mean length of a document."""
    corpus = index.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("mean")).first()
    freq = index.select(F.explode("postings.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(freq, "term").select("query_id", F.struct("term", (F.col("weight") * idf).alias("w")).alias("w"))
    weighted = weighted.groupBy("query_id").agg(F.collect_list("w").alias("weights"))
    once = queries.dropDuplicates(["query_id"])
    return materialize(once.join(weighted, "query_id", "left"), "weighted-questions"), corpus["mean"] or 1.0


def in_kernel(scored: DataFrame, asked: DataFrame, mean: float, kernel: Callable, schema: T.StructType) -> DataFrame:
    """Rows that ``kernel(batches, block)`` gives for all the written questions ``asked`` over the written rows ``scored``.

    Questions that fit one block go to the tasks as one; more of them stream past the rows instead.
    """
    arrow = to_arrow_schema(schema)

    def batches_of(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    size = F.sum(F.greatest(F.size("weights"), F.lit(0)))
    questions, words = asked.agg(F.count(F.lit(1)), size).first()
    if questions <= BLOCK_QUESTIONS and (words or 0) <= BLOCK_WORDS:
        block = scored.sparkSession.sparkContext.broadcast(QuestionBlock.of([r.asDict(True) for r in asked.collect()], mean))
        return scored.mapInArrow(lambda batches: batches_of(kernel(batches, block.value)), schema)
    rows, listed = scored.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("postings"), F.lit(0)))).first()
    splits = max(1, -(-rows // SPLIT_ROWS), -(-(listed or 0) // SPLIT_POSTINGS))
    most, heavy = BLOCK_QUESTIONS, BLOCK_WORDS

    def stream(held: list[pa.RecordBatch], some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, weight = [], 0
        for row in some.to_pylist():
            mine = len(row["weights"] or ())
            if block and (len(block) == most or weight + mine > heavy):
                yield from batches_of(kernel(iter(held), QuestionBlock.of(block, mean)))
                block, weight = [], 0
            block.append(row)
            weight += mine
        if block:
            yield from batches_of(kernel(iter(held), QuestionBlock.of(block, mean)))

    return against_all(scored, asked, splits, stream, schema)


def ranking_schema(queries: DataFrame, documents: DataFrame, doc_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def bm25_topk(
    documents: DataFrame, queries: DataFrame, k: int = 10, *, doc_id: str, content: str, report: Callable[[int, int], None] | None = None
) -> DataFrame:
    """Best ``k`` documents per query by Okapi BM25: ``(query_id, doc_id, score, rank)``.

    Words are counted where the documents lie, and scored in blocks of documents; a block that cannot reach a query's k-th best
    score is left out (``report`` is told how many cells were met and left out, inside the tasks). What is shuffled
    is ``k`` rows per query and task.
    """
    terms = materialize(query_terms(queries), "terms")
    index = materialize(postings(documents, terms, doc_id=doc_id, content=content), "postings")
    asked, mean = weighted_questions(index, queries.select("query_id"), terms)
    found = in_kernel(
        index.filter(F.size("postings") > 0), asked, mean, lambda batches, block: best_keywords(batches, block, k, report),
        ranking_schema(queries, documents, doc_id),
    )
    return top_k(found, k).select("query_id", "doc_id", "score", "rank")


def chunk_text(documents: DataFrame, *, doc_id: str, content: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Overlapping character chunks ``(doc_id, chunk_no, chunk)``; row-local, no shuffle."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(content) - overlap) / step), F.lit(1)).cast("int") - 1
    return documents.select(
        F.col(doc_id).alias("doc_id"), F.col(content).alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    ).select("doc_id", "chunk_no", F.substring(F.col("_text"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def chunk_counts(documents: DataFrame, *, doc_id: str, content: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks per document, from its length alone."""
    count = F.greatest(F.ceil((F.length(content) - overlap) / (size - overlap)), F.lit(1))
    return documents.select(F.col(doc_id).alias("doc_id"), count.cast("bigint").alias("chunks"))
