"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirewise.llm import runs as module
from quirewise.llm.runs import find_runs, op11, periodic_runs


def brute(x):
    """All (begin, end, smallest period) with at least two periods."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return {(b, e, q) for (b, e), q in found.items()}


def found_in(x):
    x = np.array([*x, -1], np.int64)
    return {tuple(map(int, r)) for r in zip(*find_runs(x, np.array([len(x) - 1])), strict=True)}


def fibonacci(n, a=(1,), b=(1, 0)):
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


@pytest.mark.parametrize("x", [
    [], [1], [1, 1], [1] * 200, [1, 2] * 100, fibonacci(600), thue_morse(600), thue_morse(64) * 5,
    ([1, 2] * 20 + [1]) * 2, ([1, 2] * 20 + [1]) * 3 + [1, 2] * 9, [1] * 40 + [2] + [1] * 40 + [2] + [1] * 33,
    [1, 2, 3] * 30 + [1, 2] + [1, 2, 3] * 31, [5, 6, 5, 6, 5] * 2 + list(range(90)) * 2, ([1, 2] * 9 + [1] * 15) * 4,
])
def test_known_words(x):
    assert found_in(x) == brute(x)


def test_two_blocks_of_a_small_period():
    for p in (1, 2, 3, 4):
        root = list(range(1, p + 1))
        for size in range(9 * p, 14 * p):
            for cut in range(p + 1):
                x = (root * 20)[:size] + (root * 20)[cut : cut + size + p]
                assert found_in(x) == brute(x), (p, size, cut)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3), st.lists(st.integers(0, 3), min_size=1, max_size=14), st.data())
def test_composed_words(letters, seed, data):
    x = [s % letters for s in seed]
    for _ in range(data.draw(st.integers(0, 5))):
        kind = data.draw(st.integers(0, 3))
        if kind == 0:
            x = x * data.draw(st.integers(1, 4))
        elif kind == 1:
            x = x + x[: data.draw(st.integers(0, len(x)))]
        elif kind == 2:
            x = x[data.draw(st.integers(0, len(x) - 1)) :] + x
        else:
            x = x + [data.draw(st.integers(0, letters))]
        x = x[:400]
    assert found_in(x) == brute(x)


def test_long_random_texts_with_large_periods():
    rnd = random.Random(5)
    for _ in range(20):
        block = [rnd.randrange(4) for _ in range(rnd.randrange(30, 220))]
        x = [rnd.randrange(4) for _ in range(50)] + block * rnd.randrange(2, 4) + block[: rnd.randrange(30)] + [9]
        assert found_in(x) == brute(x)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    kept = sorted((b, e - b, q) for b, e, q in brute(words) if e - b >= max(12, 2 * q))
    gone = {i for b, length, q in kept for i in range(b + q, b + length)}
    best = min(kept, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{b},{length},{q}\n" for b, length, q in kept)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if not kept else 1000 * best[1] // best[2]
    return (doc_id, len(kept), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "b", "é", "x y", "word", "zz"]
    out = []
    for _ in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 11, 40, 120]))]
        if rnd.random() < 0.5:
            words += words[-rnd.randrange(1, 40) :] * rnd.randrange(1, 5)
        out.append(rnd.choice([" ", "\n", "\t ", "\r\n"]).join(words))
    return out


def test_rows_match_brute_force(spark):
    rows = list(enumerate(texts(3, 150))) + [(7, "again and again " * 9), (None, "la " * 40), (1000, None), (1001, ""), (1002, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in op11(df.selectExpr("*", "'x' as period", "1 as n_runs")).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)


def test_columns_are_carried_and_text_collapsed(spark):
    df = spark.createDataFrame([(1, "go " * 20, "k"), (2, "no runs", None)], "doc_id long, text string, collapsed_text string")
    made = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    assert made[1]["collapsed_text"] == "go" and made[1]["text"] == "go " * 20
    assert made[2]["collapsed_text"] == "no runs" and made[2]["n_runs"] == 0
    assert periodic_runs(df.filter("doc_id = 0")).count() == 0


def test_pieces_do_not_change_results(spark, monkeypatch):
    rows = list(enumerate(texts(4, 60)))
    batch = module.pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    whole = module._described(batch, "text", module._with_planted_run)
    alone = [module._described(batch.slice(i, 1), "text", module._with_planted_run) for i in range(len(rows))]
    assert [c.to_pylist() for c in whole] == [[a[k][0].as_py() for a in alone] for k in range(len(whole))]
