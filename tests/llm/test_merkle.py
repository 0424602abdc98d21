"""Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest

from quirewise.llm.merkle import manifest, op13

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top and, for each node, its steps (left, right) up to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            steps[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[i] = place // 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, upper = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, steps), above in zip(trees, upper, strict=True):
        for row, path in zip(mine, steps, strict=True):
            other = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                other = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            node = leaf(other)
            for left, right in path + above:
                node = h(left, node, right)
            out.append((row[0], leaf(row), subroot, root, h(*(x for s in path + above for x in s)), node, node == root))
    return sorted(out, key=repr)


def table(seed, n, sources):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(sources)
        text = rnd.choice([None, "", "Ab C", "ÄÖ text", "plain", "X" * rnd.randrange(40)])
        rows.append((rnd.choice([i, i, i, i // 2, None]) if n < 400 else i, source, rnd.choice(["en", None, ""]), rnd.choice([None, 0, -3, 10**12]), text))
    return rows + rows[: n // 20]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (17, ["a", None]), (300, [None, "", "b", "é", "z"]), (700, [f"s{i}" for i in range(300)])])
def test_rows_match_a_plain_tree(spark, n, sources):
    rows = table(n, n, sources)
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as rank", "'x' as leaf", "0 as tree").repartition(5)
    assert sorted((tuple(r) for r in op13(df).collect()), key=repr) == expected(rows)


def test_one_source_of_several_levels(spark):
    rows = [(i, "only", "en", i, f"Text {i}") for i in range(4500)]
    assert sorted((tuple(r) for r in op13(spark.createDataFrame(rows, COLUMNS)).collect()), key=repr) == expected(rows)


def test_empty_table_and_no_tampering(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert op13(empty).count() == 0
    made = manifest(spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None)], COLUMNS)).collect()
    assert [r["rank"] for r in sorted(made, key=lambda r: r["rank"])] == [0, 1] and all(r["verified"] for r in made)
