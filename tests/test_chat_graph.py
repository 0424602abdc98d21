import json
import random

import pytest
from pyspark.sql import functions as F

from quirewise.errors import RequestError
from quirewise.operators import chat, graph, triples
from quirewise.operators.ordered import total_before

TURNS = "conv_id int, turn int, role string, text string"


def by_rule(turns):
    """The folding rule applied turn by turn."""
    out, heads, asked, last = [], "", [], None
    for turn, role, text in turns:
        if role == "system":
            heads += text + "\n"
        elif role == "user":
            asked.append(text)
            last = turn
        else:
            if asked:
                out.append((last, "user", heads + "\n".join(asked)))
                heads, asked = "", []
            out.append((turn, "model", text))
    if asked:
        out.append((last, "user", heads + "\n".join(asked)))
    return out


def random_chats(count, seed):
    rng = random.Random(seed)
    return {
        c: [(3 * i, rng.choice(["system", "user", "user", "assistant"]), f"t{c}-{i}") for i in range(rng.randint(1, 25))]
        for c in range(count)
    }


FIXED = {
    1000: [(0, "assistant", "hi"), (1, "user", "q")],
    1001: [(0, "system", "s"), (1, "assistant", "a"), (2, "user", "u")],
    1002: [(0, "user", "u1"), (1, "user", "u2"), (2, "assistant", "a")],
    1003: [(0, "user", "u"), (1, "assistant", "a"), (2, "system", "late")],
    1004: [(0, "system", "only")],
    1005: [(0, "system", "s1"), (1, "user", "u"), (2, "system", "s2"), (3, "assistant", "a"), (4, "user", "v")],
}


@pytest.mark.parametrize("segment", [2, 7, 4096])
def test_folding_follows_the_rule(spark, segment):
    chats = {**random_chats(40, segment), **FIXED}
    rows = [(c, *turn) for c, turns in chats.items() for turn in turns]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = {}
    for r in chat.fold_chat(df, segment).collect():
        got.setdefault(r["conv_id"], []).append((r["at_turn"], r["role"], r["text"]))
    for c, turns in chats.items():
        assert sorted(got.get(c, [])) == sorted(by_rule(turns)), c


@pytest.mark.parametrize("segment", [5, 4096])
def test_payload_parts_join_to_the_request(spark, segment):
    chats = {**random_chats(10, 1), **FIXED}
    rows = [(c, *turn) for c, turns in chats.items() for turn in turns]
    parts = chat.chat_payload(spark.createDataFrame(rows, TURNS), segment=segment).collect()
    for c, turns in chats.items():
        text = "".join(r["payload"] for r in sorted(parts, key=lambda r: r["part"]) if r["conv_id"] == c)
        want = [{"role": role, "parts": [{"text": t}]} for _, role, t in by_rule(turns)]
        if want:
            assert json.loads(text) == {
                "contents": want, "generationConfig": {"temperature": 0.1, "maxOutputTokens": 2048},
            }


def test_response_parsing(spark):
    good = json.dumps({"candidates": [{"content": {"parts": [{"text": "yes"}]}}]})
    df = spark.createDataFrame([(1, good), (2, "{}"), (3, "broken")], "id int, body string")
    out = {r["id"]: r for r in chat.parse_response(df, "body").collect()}
    assert out[1]["answer"] == "yes" and out[1]["error"] is None
    assert out[2]["answer"] is None and "Failed to parse" in out[2]["error"] and "Failed to parse" in out[3]["error"]


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.randint(0, 5)) for i in range(500)] + [("cold", i * 100, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(6)
    got = {(r["k"], r["n"]): r["t"] for r in total_before(df, ["k"], "n", F.col("v"), "t", segment=16).collect()}
    sums = {}
    for k, n, v in rows:
        assert got[(k, n)] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


# ---- graph ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(i, "t", {"n": i}) for i in "abcd"], "id string, type string, properties map<string,string>")
    edges = spark.createDataFrame(
        [("a", "b", "x", None), ("a", "b", "x", None), ("a", "c", "y", {"w": "1"}), ("b", "d", "x", None), ("d", "a", "x", None),
         ("a", "zz", "x", None), ("zz", "a", "x", None)],
        "src string, dst string, type string, properties map<string,string>",
    )
    return nodes, edges


def test_edges_need_both_ends(small):
    nodes, edges = small
    valid, rejected = graph.check_edges(edges, nodes)
    assert valid.count() == 5 and rejected.count() == 2
    assert valid.filter("properties is null").count() == 0


def test_traversal(spark, small):
    nodes, edges = small
    starts = spark.createDataFrame([("a",), ("zz",), ("none",)], "start string")
    valid, _ = graph.check_edges(edges, nodes)
    every = graph.traverse(starts, valid, nodes).collect()
    assert sorted((r["start"], r["id"]) for r in every) == [("a", "b"), ("a", "b"), ("a", "c")]
    assert graph.traverse(starts, valid, nodes, "y").collect()[0]["properties"] == {"n": "c"}


@pytest.mark.parametrize("hops, expected", [(1, {"b": 1, "c": 1}), (2, {"b": 1, "c": 1, "d": 2}), (5, {"b": 1, "c": 1, "d": 2})])
def test_hops(spark, small, hops, expected):
    nodes, edges = small
    starts = spark.createDataFrame([("a",)], "start string")
    valid, _ = graph.check_edges(edges, nodes)
    assert {r["id"]: r["hop"] for r in graph.traverse_hops(starts, valid, hops).collect()} == expected


def test_node_upsert_and_delete(spark, small):
    nodes, edges = small
    writes = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "id string, seq int, type string")
    assert graph.upsert_nodes(writes, "seq").first()["type"] == "new"
    left, links = graph.delete_nodes(nodes, edges, spark.createDataFrame([("b",), ("absent",)], "id string"))
    assert left.count() == 3 and links.filter("src = 'b' or dst = 'b'").count() == 0
    assert graph.traverse(spark.createDataFrame([("a",)], "start string"), links, left).count() == 1


# ---- triples -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("ann", "likes", "bob"), ("ann", "likes", "bob"), ("bob", "likes", "bob"), ("bob", "in", "rome"), ("rome", "in", "italy")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_delete_removes_one_occurrence(spark, facts):
    gone = spark.createDataFrame([("ann", "likes", "bob"), ("no", "such", "fact")], facts.schema)
    left = triples.delete_triples(facts, gone)
    assert left.count() == 4 and left.filter("s = 'ann'").count() == 1


def test_patterns(facts):
    assert triples.match_pattern(facts, (None, "likes", "bob")).count() == 3
    assert [r["s"] for r in triples.match_pattern(facts, ("?x", "likes", "?x")).collect()] == ["bob"]
    joined = triples.match_patterns(facts, [("?who", "likes", "?x"), ("?x", "in", "?city"), ("?city", "in", "?land")])
    assert sorted((r["who"], r["land"]) for r in joined.collect()) == [("ann", "italy"), ("ann", "italy"), ("bob", "italy")]
    with pytest.raises(RequestError):
        triples.match_patterns(facts, [("?a", "likes", "?b"), ("?c", "in", "?d")])


def test_search_is_case_sensitive_and_spans_positions(spark, facts):
    assert triples.search_triples(facts, "n likes b").count() == 2
    assert triples.search_triples(facts, "Ann").count() == 0
    queries = spark.createDataFrame([(1, "n likes b"), (2, "Ann"), (3, "in")], "query_id int, text string")
    found = triples.batch_search_triples(facts, queries).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {1: 2, 3: 2}
    assert triples.add_triples(facts, facts).count() == 10
