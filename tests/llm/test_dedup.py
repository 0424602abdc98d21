"""Shingle join and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirewise.llm import suffixes
from quirewise.llm.components import components
from quirewise.llm.jaccard import jaccard_components
from quirewise.llm.suffixes import IndexFamily, remove_repeats


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    low = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {(i, len(s), c) for (i, _), s, c in zip(rows, sets, low, strict=True)}


def near_copies(seed, groups=8, size=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 30, 80, 200]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words + (passage if rnd.random() < 0.2 else [])))
    rows += ["", None, "  ", "one", "One", "one two", passage_text := " ".join(passage), passage_text.upper()]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as n")
    assert {tuple(r) for r in jaccard_components(docs).collect()} == brute_components(rows)


def test_component_edge_cases(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (3, "A  B\tc"), (None, "a b c"), (9, None)], "doc_id long, text string")
    got = sorted(jaccard_components(docs).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(3, 1, 3), (5, 1, 3), (5, 1, 3), (None, 1, 3), (9, 0, 9)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 260)], 100)}


def brute_removal(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.setdefault(i, []).append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {(i, *x) for i, found in out.items() for x in found}


def repeats(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh é日 "
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.choice([30, 49, 50, 51, 75, 200]))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randrange(0, 5) :] if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(70)) for _ in range(4)]
        rows.append((i * 3 - 20, "".join(parts)))
    return rows + [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 120 + "b"), (504, "ab" * 100), (505, "x" * 49), (506, "x" * 49)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_brute_force(spark, seed):
    rows = repeats(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(docs).drop("kept_text", "had_text").collect()
    assert {tuple(r) for r in got} == brute_removal(rows)


def test_removal_with_long_texts_across_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[1_048_000:1_049_500] + "!" + long[:60]), (3, "zz" + long)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (1560, 2), 3: (3_000_000, 1)}


def test_removal_edge_cases(spark):
    text = "the same long line that comes more than once in here, at last"
    rows = [(2, text), (2, text), (2, "other " + text), (None, text), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tag", "'k' as whole", "3 as n_bytes_in")
    got = remove_repeats(docs, carry=["tag", "whole"]).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.tag, r.whole) for r in got) == [
        ("2", 0, 1, "k"), ("2", 0, 1, "k"), ("2", 0, 1, "k"), ("4", len(text), 1, "k"), ("None", 0, 1, "k")
    ]
    assert remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30), min_size=1, max_size=12))
def test_index_family_finds_what_earlier_batches_hold(batches):
    family, seen = IndexFamily(), set()
    for number, batch in enumerate(batches):
        first, around = np.array([b[0] for b in batch], np.uint32), np.array([b[1] for b in batch], np.uint64)
        assert family.find(first, around).tolist() == [b in seen for b in batch]
        family.add(*suffixes._sorted_once(first, around, np.full(len(batch), number)))
        seen |= set(batch)
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
