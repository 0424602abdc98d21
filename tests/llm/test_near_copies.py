"""Near-duplicate joins on groups that meet in one tile, on long words, and MinHash against brute force."""

import random

import numpy as np
import pytest

from quirewise.llm import linking
from quirewise.llm.jaccard import RULE as JACCARD
from quirewise.llm.jaccard import _bitmap, jaccard_components
from quirewise.llm.linking import fingerprint
from quirewise.llm.minhash import MINIMA, STEP, band_keys, near_duplicates, signatures
from quirewise.llm.texthash import shingle_sets
from tests.llm.test_dedup import near_copies, shingles


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    low, of = [i for i, _ in rows], list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    name = {}
    for k, i in enumerate(low):
        name[root(k)] = min(name.get(root(k), i), i)
    return {(i, len(s), name[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def one_word_changed(size, length, seed=4):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(size):
        words = list(base)
        words[rnd.randrange(length)] = f"x{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("length", [64, 90])
@pytest.mark.parametrize(("find", "percent"), [(jaccard_components, 80), (near_duplicates, 85)])
def test_many_copies_that_differ_in_one_word(spark, find, percent, length):
    rows = one_word_changed(300, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r)[:3] for r in find(df).collect()} == brute(rows, percent)


def packed(texts, sketch_of):
    sets = shingle_sets(linking.pa.array(texts))
    return sets, [fingerprint(s) for s in sets], sketch_of(sets)


def test_units_return_fewer_links_than_classes(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 100)
    texts = [t for _, t in one_word_changed(400, 90)]
    sets, names, sketches = packed(texts, lambda sets: [_bitmap(s) for s in sets])
    classes = [(f, i, len(s), bytearray(x)) for i, (f, s, x) in enumerate(zip(names, sets, sketches, strict=True))]
    classes = spark.createDataFrame(classes, "fp long, rep long, n long, sketch binary")
    tiles = spark.range(3).selectExpr("id as tile").crossJoin(classes.select("fp", "n", "rep").filter("rep < 300"))
    tiles = tiles.unionByName(classes.selectExpr("cast(9 as long) as tile", "fp", "n", "rep"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {(a, b) for a in range(400) for b in range(a) if JACCARD.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    star = linking.first_links(docs, classes, tiles, JACCARD)
    units = linking.open_units(classes, tiles, star, JACCARD)
    rows = units.count()
    assert rows <= 10 * 2 * 400 < len(pairs)  # a row for each class of a pair of blocks at most
    found = [tuple(r) for r in linking._decide_units(docs, classes, units, JACCARD).collect()]
    of = {f: i for i, f in enumerate(names)}
    assert all((max(of[a], of[b]), min(of[a], of[b])) in pairs for a, b in found) and len(found) < rows
    roots = {r.node: r.root for r in linking.linked_components(docs, classes, tiles, JACCARD).collect()}
    groups = {}
    for f, i in of.items():
        groups.setdefault(roots.get(f, f), set()).add(i)
    want = brute(list(enumerate(texts)), 80)
    names_of = {i: c for i, _, c in want}
    assert all(len({names_of[i] for i in g}) == 1 for g in groups.values()) and len(groups) == len(set(names_of.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_matches_brute_force(spark, seed):
    rows = near_copies(seed) + [(None, "one"), (1001, None), (1002, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tile", "'s' as sketch").repartition(3)
    got = near_duplicates(df).collect()
    with_id = [r for r in rows if r[0] is not None]
    assert {tuple(r)[:3] for r in got if r.doc_id is not None} == brute(with_id, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


def test_signatures_are_minima_whatever_the_cut():
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (3, 0, STEP + 5, 1, 3 * STEP, 40, STEP, 7)]
    whole = signatures(sets)
    for s, row in zip(sets, whole, strict=True):
        alone = signatures([s])[0] if len(s) < STEP else np.min([signatures([part])[0] for part in np.array_split(s, 7)], axis=0)
        assert (row == alone).all()
    a, b = rnd.integers(0, 2**63, (2, 4000), dtype=np.uint64)
    shared = signatures([np.concatenate([a, b[:1000]]), a])
    assert abs((shared[0] == shared[1]).mean() - 0.8) < 4 * np.sqrt(0.16 / MINIMA)
    assert len(np.unique(band_keys(whole[[0]]))) == MINIMA // 4


@pytest.mark.parametrize("find", [jaccard_components, near_duplicates])
def test_words_longer_than_a_hash_block(spark, find):
    a, b = "a" * 4096, "b" * 4096
    rows = [(1, a + b), (2, b + a), (3, a + b), (4, a * 3 + b), (5, b + a * 3)]
    got = {r.doc_id: r.component_id for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_bitmap_bound_never_hides_a_link():
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(50)]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    texts = [" ".join(w if rnd.random() < 0.97 else rnd.choice(vocabulary) for w in base) for _ in range(40)]
    sets, _, sketches = packed(texts, lambda sets: np.array([_bitmap(s) for s in sets], object))
    n = np.array([len(s) for s in sets])
    may = JACCARD.may(sketches, n, sketches, n)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert may[i, j] or not JACCARD.linked(len(np.intersect1d(s, t)), len(s), len(t))
