import itertools
import random

import pytest

from quirewise.errors import RequestError
from quirewise.operators import graph, triples


def brute(rows, patterns):
    found = []
    for chosen in itertools.product(rows, repeat=len(patterns)):
        values, fits = {}, True
        for triple, pattern in zip(chosen, patterns):
            for value, term in zip(triple, pattern):
                if term.startswith("?"):
                    fits = fits and value is not None and values.setdefault(term[1:], value) == value
                else:
                    fits = fits and value == term
        if fits:
            found.append(tuple(sorted(values.items())))
    return sorted(found)


@pytest.mark.parametrize("patterns", [
    [("?a", "k", "?b"), ("?b", "k", "?c"), ("?c", "k", "?a")],
    [("?n", "k", "?x"), ("?x", "l", "?pattern"), ("?n", "l", "?pattern")],
    [("?a", "k", "?b"), ("?b", "k", "?c"), ("?c", "l", "?d")],
    [("?a", "k", "?b"), ("?b", "k", "?b"), ("?a", "l", "n1")],
])
def test_patterns_of_any_shape(spark, patterns):
    rnd = random.Random(6)
    rows = [(f"n{rnd.randrange(7)}", rnd.choice("kl"), f"n{rnd.randrange(7)}") for _ in range(40)]
    rows += rows[:5]  # copies count
    got = triples.match_patterns(spark.createDataFrame(rows, "s string, p string, o string").repartition(3), patterns).collect()
    assert sorted(tuple(sorted(r.asDict().items())) for r in got) == brute(rows, patterns)


@pytest.mark.parametrize("hubs", [False, True])
def test_cycles_open_where_a_variable_decides_another(spark, monkeypatch, hubs):
    """Each shop has one town, so two patterns are joined; among hubs that all link to each other that would be too many rows."""
    rnd = random.Random(8)
    if hubs:
        rows = [(f"a{i}", p, f"a{j}") for i in range(12) for j in range(12) for p in ("buys", "sells", "lives") if rnd.random() < 0.9]
    else:
        rows = [(f"c{rnd.randrange(30)}", "buys", f"s{rnd.randrange(20)}") for _ in range(200)]
        rows += [(f"s{i}", "sells", f"n{i % 3}") for i in range(20)] + [(f"c{i}", "lives", f"n{i % 3}") for i in range(30)]
    shared = []
    plain = triples._shared
    monkeypatch.setattr(triples, "_shared", lambda *given: shared.append(1) or plain(*given))
    table = spark.createDataFrame(rows, "s string, p string, o string")
    got = triples.match_patterns(table, [("?c", "buys", "?s"), ("?s", "sells", "?n"), ("?c", "lives", "?n")]).collect()
    by = {p: [(s, o) for s, q, o in rows if q == p] for p in ("buys", "sells", "lives")}
    want = [(c, s, n) for c, s in by["buys"] for t, n in by["sells"] if t == s for d, m in by["lives"] if (d, m) == (c, n)]
    assert sorted(tuple(r) for r in got) == sorted(want) and bool(shared) == hubs


def test_patterns_that_share_nothing_are_refused(spark):
    table = spark.createDataFrame([("a", "k", "b")], "s string, p string, o string")
    with pytest.raises(RequestError):
        triples.match_patterns(table, [("?a", "k", "?b"), ("?c", "k", "?d")])


def test_frontiers_have_a_row_for_each_node_and_block(spark):
    rnd = random.Random(3)
    nodes = [f"n{i}" for i in range(150)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), rnd.choice("xy")) for _ in range(400)] + [(n, "hub", "x") for n in nodes]
    table = spark.createDataFrame(edges, "src string, dst string, type string").repartition(4)
    starts = spark.createDataFrame([(n,) for n in nodes] + [("n1",)], "start string")
    for relationship in ("", "x"):
        links = {(a, b) for a, b, t in edges if t == relationship or not relationship}
        want = set()
        for start in nodes:
            seen, front = {start}, {start}
            for hop in (1, 2, 3):
                front = {b for a, b in links if a in front} - seen
                seen |= front
                want |= {(start, b, hop) for b in front}
        assert {tuple(r) for r in graph.traverse_hops(starts, table, 3, relationship).collect()} == want
    numbered = graph.numbered_starts(starts)
    blocks = numbered.select("block").distinct().count()
    for frontier in graph.frontiers(numbered, table, 3):
        assert frontier.count() <= 151 * blocks
    assert graph.traverse_hops(starts, table, 0).count() == 0


def test_starts_with_one_neighbour_walk_together(spark):
    """Starts of 16 nations, their names in turn: a block holds one nation, so its frontier is that nation and its members."""
    links = spark.createDataFrame([(f"c{i:04}", f"n{i % 16:02}", "in") for i in range(1024)], "src string, dst string, type string")
    both = links.unionByName(links.selectExpr("dst as src", "src as dst", "type"))
    starts = links.select(links.src.alias("start"))
    numbered = graph.numbered_starts(starts, both)
    first, second = graph.frontiers(numbered, both, 2)[1:]
    assert numbered.select("block").distinct().count() < 32
    assert first.count() < 2 * 16 and second.count() < 2 * 1024
    assert graph.traverse_hops(starts, both, 2).count() == 1024 + 1024 * 63


def test_starts_with_the_same_neighbours_are_one_class(spark):
    """All 1,024 starts of 4 nations walk as 4 bits of one block: a frontier has a row for a node, not for a node and 64 starts."""
    links = spark.createDataFrame([(f"c{i:04}", f"n{i % 4}", "in") for i in range(1024)], "src string, dst string, type string")
    both = links.unionByName(links.selectExpr("dst as src", "src as dst", "type"))
    numbered = graph.numbered_starts(links.select(links.src.alias("start")), both)
    first, second = graph.frontiers(numbered, both, 2)[1:]
    assert numbered.count() == 1024 and numbered.select("block", "bit").distinct().count() == 4
    assert first.count() == 4 and second.count() == 1024


@pytest.mark.parametrize("dealt_pairs, max_bytes", [(0, 1 << 26), (1 << 40, 1 << 26), (1 << 40, 0)])
def test_hops_of_starts_that_are_alike(spark, monkeypatch, dealt_pairs, max_bytes):
    """Twins that link to themselves and to each other, hubs, null ends, unknown starts, several pieces and parts of a class."""
    for name, value in {"TWIN_LINKS": 3, "PIECE_STARTS": 3, "PART_SLOTS": 2, "LEAST_PAIRS": 50, "DEALT_PAIRS": dealt_pairs, "MAX_BYTES": max_bytes}.items():
        monkeypatch.setattr(graph, name, value)
    rnd = random.Random(8)
    ways = [(f"c{i}", f"n{i % 4}") for i in range(90)] + [(f"n{i}", f"r{i % 2}") for i in range(4)]
    ways += [(b, a) for a, b in ways] + [(f"c{i}", f"c{i}") for i in range(0, 90, 7)] + [("c1", None), ("c5", None), ("n2", None), (None, "n1")]
    ways += [(f"t{i}", f"t{j}") for i in range(3) for j in range(3)] + [("hub", f"c{i}") for i in range(9)] + [("t0", "hub"), ("u", "t0")]
    ways += [(f"d{i}", None if d == 9 else f"d{d}") for i in range(40) for d in rnd.sample(range(10), 2)]
    table = spark.createDataFrame([(a, b, "x") for a, b in ways + ways[:20]], "src string, dst string, type string").repartition(4)
    starts = sorted({a for a, _ in ways if a} | {"absent", "r0"})
    want = set()
    for start in starts:
        seen, front = {start}, {start}
        for hop in (1, 2, 3):
            front = {b for a, b in ways if a is not None and a in front} - seen
            seen |= front - {None}
            want |= {(start, b, hop) for b in front}
    given = spark.createDataFrame([(s,) for s in [*starts, "c1", None]], "start string")
    rows = [tuple(r) for r in graph.traverse_hops(given, table, 3).collect()]
    assert len(rows) == len(want) and set(rows) == want
