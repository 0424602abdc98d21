import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.functions import matching
from quirewise.functions import ranking
from quirewise.operators import answers, entities, hybrid, keyword, vectors
from quirewise.operators.vector_index import rejected_vectors


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta9"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_batch_search_equals_one_by_one(spark, library):
    special = spark.createDataFrame(
        [(100, "100% Alpha_beta\\x"), (101, "gammaXbeta"), (102, "É")], "doc_id int, text string"
    )
    docs = library.unionByName(special)
    texts = ["alpha beta", "GAMMA_BETA", "0%a", "\\", "%", "é", "nothing like it", "beta%gamma", "_", "a_\\", ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    found = keyword.batch_keyword_search(docs, queries, doc_id="doc_id", content="text").collect()
    got = sorted((r["query_id"], r["doc_id"]) for r in found)
    want = []
    for i, text in enumerate(texts):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text.lower())
        want += [
            (i, r["doc_id"]) for r in docs.collect() if re.search(pattern, r["text"].lower(), flags=re.DOTALL)
        ]
    assert got == sorted(want)


def test_queries_do_not_change_each_other(spark, library):
    texts = ["alpha", "beta gamma", "zeta9", "delta alpha", "épsilon", "gamma gamma%alpha", "t"]
    queries = spark.createDataFrame(list(enumerate(texts * 3)), "query_id int, text string")

    def run(queries):
        out = keyword.batch_keyword_search(library, queries, doc_id="doc_id", content="text")
        return sorted(tuple(r) for r in out.collect())

    whole = run(queries)
    assert sorted(sum((run(queries.filter(f"query_id % 3 = {i}")) for i in range(3)), [])) == whole


def test_pieces_cover_all_rows(monkeypatch):
    monkeypatch.setattr(matching, "PIECE_BYTES", 7)
    texts = ["abc", None, "", "a longer text than a piece", "xy", None, "z"]
    batch = matching.pa.RecordBatch.from_pydict({"t": texts}).slice(1)
    seen = [(p["t"].to_pylist(), bytes(d), o.tolist()) for p, d, o in matching._pieces(batch, "t")]
    assert sum((t for t, _, _ in seen), []) == [t for t in texts[1:] if t is not None]
    assert all(bytes(d) == "".join(t).encode() and o[-1] == len(d) for t, d, o in seen)


def test_grams_are_those_of_the_text():
    data = "x" * 20 + "an anchor of thirty bytes or so" + "é" * 9
    named = {w: set(g.tolist()) for w, g in matching._named(np.frombuffer(data.encode(), np.uint8))}
    for text in ("an anchor of thirty bytes or so", "anchor", "é", "xa", "n an", "éééé", "a%thirty bytes or so_"):
        assert all(any(g in s for s in named.values()) for g in matching.grams_of(text, True)), text
    assert matching.grams_of("%_", True) == [matching.EVERYWHERE] and matching.grams_of("%_", False) != [matching.EVERYWHERE]
    assert not any(g in s for s in named.values() for g in matching.grams_of("another text than this one", True)[1:3])


def test_repeated_rows_queries_and_nulls(spark):
    docs = spark.createDataFrame([(1, "The cat"), (1, "The cat"), (2, None), (3, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "cat"), (1, "cat"), (1, "the"), (2, ""), (3, None)], "query_id int, text string")
    found = keyword.batch_keyword_search(docs, queries, doc_id="doc_id", content="text")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1)] * 6 + [(2, 1)] * 2 + [(2, 3)]
    assert keyword.batch_keyword_search(docs.limit(0), queries, doc_id="doc_id", content="text").count() == 0
    assert keyword.batch_keyword_search(docs, queries.limit(0), doc_id="doc_id", content="text").count() == 0


def test_batch_search_scans_once_and_collects_no_query(spark, library):
    queries = spark.createDataFrame([(i, f"alpha {w}") for i, w in enumerate(["beta", "delta"] * 300)], "query_id int, text string")
    plan = keyword.batch_keyword_search(library, queries, doc_id="doc_id", content="text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Union" not in plan and "MapInArrow" not in plan


def test_hits_per_query_counts_zero(spark, library):
    queries = spark.createDataFrame([(1, "no such text")], "query_id int, text string")
    hits = keyword.batch_keyword_search(library, queries, doc_id="doc_id", content="text")
    assert keyword.hits_per_query(hits, queries).first()["hits"] == 0


def bm25(docs, query, k1=1.5, b=0.75):
    tokens = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    scores = {}
    for term in re.findall(r"[^\W_]+", query.lower()):
        df = sum(term in t for t in tokens.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for d, t in tokens.items():
            tf = t.count(term)
            if tf:
                part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
                scores[d] = scores.get(d, 0) + part
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("small", [True, False])
def test_bm25_equals_brute_force(spark, library, monkeypatch, small):
    if not small:
        monkeypatch.setattr(keyword, "BLOCK_QUESTIONS", 1)
        monkeypatch.setattr(ranking, "SLICE_CELLS", 2)
    texts = {1: "Alpha delta", 2: "épsilon épsilon beta", 3: "missing"}
    queries = spark.createDataFrame(list(texts.items()), "query_id int, text string")
    got = keyword.bm25_topk(library, queries, 5, doc_id="doc_id", content="text").collect()
    docs = {r["doc_id"]: r["text"] for r in library.collect()}
    for q, text in texts.items():
        mine = [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == [(d, pytest.approx(s, abs=2e-6)) for d, s in bm25(docs, text)[:5]]


def test_documents_made_only_of_query_terms_count(spark):
    docs = spark.createDataFrame([(1, "x x"), (2, "y"), (3, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "x y")], "query_id int, text string")
    got = keyword.bm25_topk(docs, queries, doc_id="doc_id", content="text").orderBy("rank").collect()
    want = bm25({1: "x x", 2: "y", 3: ""}, "x y")
    assert [(r["doc_id"], r["score"]) for r in got] == [(d, pytest.approx(s, abs=2e-6)) for d, s in want]


def test_chunks_rebuild_the_text(spark):
    texts = ["", "a" * 999, "b" * 1000, "c" * 1001, "".join(chr(97 + i % 26) for i in range(5437)), "é" * 1800]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = keyword.chunk_text(docs, doc_id="doc_id", content="text").collect()
    counts = {r["doc_id"]: r["chunks"] for r in keyword.chunk_counts(docs, doc_id="doc_id", content="text").collect()}
    for i, text in enumerate(texts):
        mine = [r["chunk"] for r in sorted(chunks, key=lambda r: r["chunk_no"]) if r["doc_id"] == i]
        assert len(mine) == counts[i] and all(len(c) <= 1000 for c in mine)
        assert mine[0] + "".join(c[200:] for c in mine[1:]) == text


# ---- vectors -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((400, 16))
    matrix[50:60] = matrix[0]  # equal vectors: ties must go to the smaller id
    rows = [(i, [float(x) for x in v], {"kind": "even" if i % 2 == 0 else "odd"}) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>, metadata map<string,string>")
    asked = [(q, rows[q * 7][1], {"kind": "odd"} if q % 3 else {}) for q in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>, filters map<string,string>")
    return df.repartition(6), queries, matrix.astype(np.float32).astype(float)


def exact(matrix, q, k, rows):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit[q], 6)
    return sorted(((i, scores[i]) for i in rows), key=lambda x: (-x[1], x[0]))[:k]


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_exact_topk_with_ties(space):
    df, queries, matrix = space
    got = result(vectors.vector_topk(df, queries, 8))
    for q in range(20):
        want = exact(matrix, q * 7, 8, range(400))
        assert [d for d, _ in got[q]] == [d for d, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-6)


def test_filters_apply_before_ranking(space):
    df, queries, matrix = space
    got = result(vectors.vector_topk(df, queries, 8, filtered=True))
    for q in range(20):
        rows = [i for i in range(400) if not q % 3 or i % 2]
        assert [d for d, _ in got[q]] == [d for d, _ in exact(matrix, q * 7, 8, rows)]


def test_vector_blocks_change_nothing(space, monkeypatch):
    df, queries, _ = space
    whole = result(vectors.vector_topk(df, queries, 5))
    monkeypatch.setattr(vectors, "MAX_BLOCK_QUERIES", 6)
    assert result(vectors.vector_topk(df, queries, 5)) == whole


def test_bucketed_search_recall(space):
    df, queries, matrix = space
    got = result(vectors.vector_topk(df, queries, 5, tables=24, bits=4))
    hits = sum(len({d for d, _ in got[q]} & {d for d, _ in exact(matrix, q * 7, 5, range(400))}) for q in range(20))
    assert hits / 100 >= 0.85
    assert all(got[q][0][1] == 1.0 for q in range(20))


def test_empty_vectors_are_skipped_and_odd_ones_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None)], "doc_id int, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 1.0]), ("none", None)], "query_id string, vector array<float>")
    assert [(r["query_id"], r["doc_id"]) for r in vectors.vector_topk(df, queries).collect()] == [("q", 1)]
    assert vectors.vector_topk(df, queries.filter("query_id = 'none'")).count() == 0
    odd = df.unionByName(spark.createDataFrame([(4, [1.0])], df.schema))
    assert [(r["query_id"], r["doc_id"]) for r in vectors.vector_topk(odd, queries).collect()] == [("q", 1)]
    refused = {r["doc_id"]: r["reason"] for r in rejected_vectors(odd, 2).collect()}
    assert refused == {2: "no vector", 3: "no vector", 4: "has 1 numbers, not 2"}


def test_text_ids_holes_and_mixed_lengths(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [1.0, 1.0]), ("d", [float("nan"), 1.0]), ("e", [0.5, None])]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [r["doc_id"] for r in vectors.vector_topk(df, queries, 2).orderBy("rank").collect()] == ["a", "b"]
    assert vectors.vector_topk(df, queries, 9).count() == 3
    mixed = queries.unionByName(spark.createDataFrame([(2, [1.0])], queries.schema))
    with pytest.raises(ValueError, match="different lengths"):
        vectors.vector_topk(df, mixed)


def test_vector_upsert(spark):
    store = spark.createDataFrame([("a", [1.0], 1)], "doc_id string, embedding array<float>, seq int")
    new = spark.createDataFrame([("a", [2.0], 2), ("a", [], 3), ("b", None, 4)], "doc_id string, embedding array<float>, seq int")
    out = vectors.upsert_vectors(store, new, "seq").collect()
    assert [(r["doc_id"], r["embedding"]) for r in out] == [("a", [2.0])]


def test_hash_embedding_is_unit_length_and_repeatable(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two one TWO"), (3, "...")], "doc_id int, text string")
    out = {r["doc_id"]: r["embedding"] for r in vectors.hash_embedding(docs, doc_id="doc_id", content="text").collect()}
    assert set(out) == {1, 2} and out[1] == out[2] and len(out[1]) == 64
    assert np.linalg.norm(out[1]) == pytest.approx(1.0)


def test_semantic_search_with_filters(spark):
    docs = spark.createDataFrame(
        [(1, "red apple", {"lang": "en"}), (2, "red apple", {"lang": "fr"}), (3, "blue sky", {})],
        "doc_id int, text string, metadata map<string,string>",
    )
    queries = spark.createDataFrame(
        [(1, "apple red", {"lang": "fr"}), (2, "sky", {})], "query_id int, text string, filters map<string,string>"
    )
    out = vectors.search_semantic(docs, queries, 1, doc_id="doc_id", content="text", filtered=True).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in out) == [(1, 2), (2, 3)]


def test_user_embedding_model(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([("a", "abc")], "id string, content string")
    assert vectors.embed_with(docs, load, content="content").first()["embedding"] == [3.0, 1.0]

    def broken():
        return lambda texts: [[1.0 / (len(t) - 2)] for t in texts]

    docs = spark.createDataFrame([("a", "abc"), ("b", "xy")], "id string, content string").coalesce(1)
    out = {r["id"]: (r["embedding"], r["embedding_error"]) for r in vectors.embed_with(docs, broken, content="content").collect()}
    assert out["a"] == ([1.0], None) and out["b"][0] is None and "ZeroDivisionError" in out["b"][1]


def test_each_row_gets_its_own_hash_embedding(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three"), (2, " .")], "doc_id int, content string")
    got = vectors.hash_embedding(docs, doc_id="doc_id", content="content").collect()
    assert [r["doc_id"] for r in got] == [1, 1] and got[0]["embedding"] != got[1]["embedding"]


# ---- fusion, context, answers --------------------------------------------------------------


@pytest.mark.parametrize("small", [True, False])
def test_fusion_ranks_over_all_scores(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(keyword, "BLOCK_QUESTIONS", 1)
        monkeypatch.setattr(ranking, "SLICE_CELLS", 3)
    docs = {i: " ".join(["alpha"] * (i % 7) + ["beta"] * (i % 5) + ["gamma"] * 3) for i in range(40)}
    table = spark.createDataFrame([*docs.items(), (90, "alpha only words")], "doc_id int, text string").repartition(4)
    docs[90] = "alpha only words"
    places = {i: [math.cos(i), math.sin(i), 0.3] for i in range(41)}
    stored = [(i, v) for i, v in places.items()] + [(91, None), (92, []), (93, [float("nan"), 1.0, 1.0])]
    vectors_ = spark.createDataFrame(stored, "doc_id int, embedding array<double>")
    asked = {1: ("alpha", [1.0, 0.2, 0.0], 0.7, 0.3), 2: ("beta alpha", None, 0.5, 0.5), 3: ("nothing", [0.0, 1.0, 0.1], 0.0, 1.0)}
    rows = [(q, *x) for q, x in asked.items()]
    queries = spark.createDataFrame(rows, "query_id int, text string, vector array<double>, vector_weight double, keyword_weight double")
    got = {}
    for r in hybrid.hybrid_weighted(table, vectors_, queries, 5, doc_id="doc_id", content="text").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))

    def unit(scores):
        low, high = (min(scores.values()), max(scores.values())) if scores else (0, 0)
        return {d: (s - low) / (high - low) if high > low else 1.0 for d, s in scores.items()}

    for q, (text, vector, a, b) in asked.items():
        cosines = {}
        if vector:
            length = math.dist(vector, [0] * 3)
            cosines = {i: round(sum(x * y for x, y in zip(v, vector)) / math.dist(v, [0] * 3) / length, 6) for i, v in places.items()}
        v, t = unit(cosines), unit(dict(bm25(docs, text)))
        fused = sorted(((-(a * v.get(d, 0) + b * t.get(d, 0)), d) for d in {*v, *t}))[:5]
        assert [d for d, _ in got.get(q, [])] == [d for _, d in fused]
        assert [s for _, s in got.get(q, [])] == [pytest.approx(-s, abs=3e-6) for s, _ in fused]


def test_contexts_hold_every_ranked_text_whole(spark):
    docs = spark.createDataFrame([(1, "a" * 9000), (2, "b")], "doc_id int, text string")
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "query_id int, doc_id int, rank int")
    out = answers.assemble_context(ranked, docs, doc_id="doc_id", content="text").first()
    assert out["context"] == "a" * 9000 + "\n\nb" and out["sources"] == "1,2"


def test_union_with_no_stores_is_empty(spark):
    queries = spark.createDataFrame([(1, "test query")], "query_id int, text string")
    assert hybrid.hybrid_union(queries).collect() == []


def test_union_asks_only_the_listed_stores(spark):
    queries = spark.createDataFrame(
        [("all", "n1", []), ("kg", "n1", ["knowledge_graph"]), ("rel", "n1", ["relational", "graph"])],
        "query_id string, text string, databases array<string>",
    )
    docs = spark.createDataFrame([("d", "t", "about N1", "txt", "u")], "id string, title string, content string, file_type string, user_id string")
    nodes = spark.createDataFrame([("n1", "a", {}), ("n2", "b", {})], "id string, type string, properties map<string,string>")
    edges = spark.createDataFrame([("n1", "n2", "x"), ("n1", "n2", "y")], "src string, dst string, type string")
    triples = spark.createDataFrame([("n1", "is", "it"), ("N1", "is", "it")], "s string, p string, o string")
    out = hybrid.hybrid_union(queries, documents=docs, nodes=nodes, edges=edges, triples=triples).collect()
    got = sorted((r["query_id"], r["source"], r["id"]) for r in out)
    assert got == [
        ("all", "graph", "n2"), ("all", "graph", "n2"), ("all", "knowledge_graph", "n1"), ("all", "relational", "d"),
        ("kg", "knowledge_graph", "n1"),
        ("rel", "graph", "n2"), ("rel", "graph", "n2"), ("rel", "relational", "d"),
    ]


def test_context_budget(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "c", 1)], "query_id int, doc_id string, rank int")
    docs = spark.createDataFrame([("a", "aaaa"), ("b", "bbbbbbbb"), ("c", "cc")], "doc_id string, text string")
    out = {r["query_id"]: r for r in answers.assemble_context(ranked, docs, doc_id="doc_id", content="text", budget=10).collect()}
    assert (out[1]["context"], out[1]["sources"]) == ("aaaa\n\nbbbbbb", "a,b")
    assert out[2]["context"] == "cc"


def test_prompts_and_answers(spark):
    questions = spark.createDataFrame([(1, "Why?"), (2, "Fail")], "query_id int, text string")
    contexts = spark.createDataFrame([(1, "Because.", "a")], "query_id int, context string, sources string")
    prompts = answers.build_prompts(questions, contexts)
    texts = {r["query_id"]: r["prompt"] for r in prompts.collect()}
    assert texts[1] == "Context:\nBecause.\n\nQuestion: Why?\n\nAnswer:"
    assert texts[2] == "Context:\n\n\nQuestion: Fail\n\nAnswer:"

    def load():
        def model(batch):
            if "Fail" in batch[0]:
                raise RuntimeError("no answer")
            return [f"echo {len(batch[0])}"]

        return model

    out = {r["query_id"]: r for r in answers.answer_prompts(prompts, load).collect()}
    assert out[1]["answer"] == f"echo {len(texts[1])}" and out[1]["sources"] == "a" and out[1]["error"] is None
    assert out[2]["answer"] is None and out[2]["error"] == "RuntimeError: no answer"


# ---- entities ------------------------------------------------------------------------------


def test_entities_have_offsets_and_plug_in(spark):
    docs = spark.createDataFrame([(1, "é Ann Lee met Bob."), (2, None), (3, "none")], "doc_id int, text string")
    found = entities.extract_entities(docs, doc_id="doc_id", content="text").collect()
    assert [(r["pos"], r["text"], r["start_char"], r["end_char"], r["label"]) for r in found] == [
        (0, "Ann Lee", 2, 9, "NAME"), (1, "Bob", 14, 17, "NAME"),
    ]

    def load():
        return lambda text: [("test", 0, 4, "MISC")]

    one = entities.extract_entities(docs.filter("doc_id = 3"), doc_id="doc_id", content="text", load_finder=load)
    assert one.first()["label"] == "MISC"


def test_last_entity_wins_as_node(spark):
    docs = spark.createDataFrame([(1, "x Bob"), (2, "Bob and Bob")], "doc_id int, text string")
    nodes = entities.entity_nodes(entities.extract_entities(docs, doc_id="doc_id", content="text")).collect()
    assert [(n["id"], n["type"], n["properties"]["start_char"]) for n in nodes] == [("Bob", "NAME", "8")]


def test_topk_never_gathers_a_whole_query(spark):
    hashed = F.xxhash64("id").cast("double").alias("score")
    scored = spark.range(1000).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), hashed)
    plan = keyword.top_k(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
