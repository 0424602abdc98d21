"""Several stores, one answer: the plain union and the weighted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from ..functions.frames import union_all
from ..functions.ranking import best_fused, bounds_of
from ..session import materialize
from .graph import traverse
from .keyword import (
    batch_keyword_search,
    in_kernel,
    postings,
    query_terms,
    ranking_schema,
    top_k,
    weighted_questions,
)
from .triples import batch_search_triples
from .vectors import vector_topk

# Answer order of the stores, and the default weights of the ranking.
STORES = ["relational", "vector", "graph", "knowledge_graph"]
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3


def _asks(queries: DataFrame, store: str) -> DataFrame:
    """Queries that want this store; an empty or missing list wants all."""
    wants = F.coalesce((F.size("databases") == 0) | F.array_contains("databases", store), F.lit(True))
    return queries.filter(wants) if "databases" in queries.columns else queries


def _envelope(hits: DataFrame, store: str, doc_id: Column, score: Column, payload: Column) -> DataFrame:
    return hits.select(
        "query_id",
        F.lit(store).alias("source"),
        F.lit(STORES.index(store)).alias("source_rank"),
        doc_id.cast("string").alias("id"),
        score.cast("double").alias("score"),
        payload.cast("map<string,string>").alias("payload"),
    )


def hybrid_union(
    queries: DataFrame,
    *,
    documents: DataFrame | None = None,
    vectors: DataFrame | None = None,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    triples: DataFrame | None = None,
    k: int = 10,
) -> DataFrame:
    """All stores' answers in one envelope, duplicates kept.

    ``queries``: ``query_id, text[, vector, filters, databases]``. A store that is not given
    answers nothing. Order the result by ``source_rank, score desc, id`` for the list form.
    The queries are read several times, so they are written out first.
    """
    parts = []
    queries = materialize(queries, "queries")
    if documents is not None:
        asked = _asks(queries, "relational").select("query_id", "text")
        titled = batch_keyword_search(
            documents, asked, doc_id="id", content="content", keep=["title", "file_type", "user_id"]
        )
        payload = F.create_map(
            F.lit("title"), "title", F.lit("file_type"), "file_type", F.lit("user_id"), F.col("user_id").cast("string")
        )
        parts.append(_envelope(titled, "relational", F.col("doc_id"), F.lit(None), payload))
    if vectors is not None and "vector" in queries.columns:
        hits = vector_topk(vectors, _asks(queries, "vector"), k, filtered="filters" in queries.columns)
        parts.append(_envelope(hits, "vector", F.col("doc_id"), F.col("score"), F.create_map()))
    if nodes is not None and edges is not None:
        starts = _asks(queries, "graph").select("query_id", F.col("text").alias("start"))
        reached = traverse(starts.select("start").distinct(), edges, nodes).join(starts, "start")
        payload = F.create_map(F.lit("type"), F.col("type"))
        parts.append(_envelope(reached, "graph", F.col("id"), F.lit(None), payload))
    if triples is not None:
        found = batch_search_triples(triples, _asks(queries, "knowledge_graph").select("query_id", "text"))
        payload = F.create_map(F.lit("s"), "s", F.lit("p"), "p", F.lit("o"), "o")
        parts.append(_envelope(found, "knowledge_graph", F.col("s"), F.lit(None), payload))
    if not parts:
        empty = queries.select("query_id").filter(F.lit(False))
        return _envelope(empty, STORES[0], F.lit(None), F.lit(None), F.create_map())
    return union_all(parts)


def hybrid_weighted(
    documents: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, *, doc_id: str, content: str
) -> DataFrame:
    """The best ``k`` documents by the weighted sum of vector and keyword score: ``(query_id, doc_id, score, rank)``.

    Per query, the cosines of all vectors and the BM25 scores of all documents that share a word are each mapped
    to 0..1 (all equal: 1); a document without one of the two scores 0 there. ``queries`` may hold ``vector_weight``
    and ``keyword_weight``. Words and vectors of a document are joined once and written out; one pass finds the bounds of
    both scores, another the fused top-k, and ``k`` rows per query and task leave it.
    """
    shares = {"vector_weight": VECTOR_WEIGHT, "keyword_weight": KEYWORD_WEIGHT}
    for name, value in shares.items():
        given = F.col(name).cast("double") if name in queries.columns else F.lit(None).cast("double")
        queries = queries.withColumn(name, F.coalesce(given, F.lit(value)))
    queries = materialize(queries.select("query_id", "text", "vector", *shares), "queries")
    sizes = [r[0] for r in queries.select(F.size("vector")).filter(F.size("vector") > 0).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise RequestError("The query vectors have different lengths.")
    terms = materialize(query_terms(queries), "terms")
    index = materialize(postings(documents, terms, doc_id=doc_id, content=content), "postings")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.filter((F.size("embedding") > 0) & usable).select("doc_id", "embedding")
    scored = index.filter(F.size("postings") > 0).join(given, "doc_id", "full_outer")
    scored = materialize(scored, "words-and-vectors")
    asked, mean = weighted_questions(index, queries.drop("text"), terms)
    limits = ["low_v", "high_v", "low_t", "high_t"]
    schema = T.StructType([queries.schema["query_id"], *(T.StructField(c, T.DoubleType()) for c in limits)])
    bounds = in_kernel(scored, asked, mean, bounds_of, schema).groupBy("query_id").agg(
        F.min("low_v").alias("low_v"), F.max("high_v").alias("high_v"), F.min("low_t").alias("low_t"), F.max("high_t").alias("high_t")
    )
    asked = materialize(asked.join(bounds, "query_id", "left"), "bounded-questions")
    ranked = in_kernel(
        scored, asked, mean, lambda batches, block: best_fused(batches, block, k), ranking_schema(queries, documents, doc_id)
    )
    return top_k(ranked, k).select("query_id", "doc_id", "score", "rank")

