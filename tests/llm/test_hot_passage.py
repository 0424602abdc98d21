"""A passage that most documents hold must not meet in one group."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from quirewise.llm import suffixes
from quirewise.llm.suffixes import remove_repeats
from tests.llm.test_dedup import brute_removal

PHRASE = "a phrase of fewer than fifty bytes in all"


def test_strings_around_a_hot_phrase_spread():
    random = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = ["".join(random.choice(letters, 60)) + PHRASE + "".join(random.choice(letters, 60)) for _ in range(400)]
    border = [[np.array([60 + 5], np.int64).tobytes()]] * 400
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int32()), pa.array(texts), pa.array(border, pa.list_(pa.binary()))],
        ["doc_id", "tag", "text", "border"],
    )
    frame = pa.Table.from_batches(list(suffixes._strings(16)(iter([rows])))).to_pandas()
    sizes = [len(b"".join(g["keys"])) for _, g in frame.groupby("part")]
    assert len(sizes) == 16 and max(sizes) < 2 * np.mean(sizes)


def test_copies_are_folded_before_the_shuffle():
    text = "".join(np.random.default_rng(6).choice(list("abcdefghij klmnop"), 500))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(300), pa.int64()), pa.array([0] * 300, pa.int32()), pa.array([text] * 300)], ["doc_id", "tag", "text"]
    )
    frame = pa.Table.from_batches(list(suffixes._suffix_blocks(16)(iter([rows])))).to_pandas()
    asked = frame[frame["first"].notna()]
    assert set(suffixes._places(asked)[0]) <= {0, 1}  # what is sampled at the edges depends on the neighbour
    found = pd.concat([suffixes._scan_part(g) for _, g in frame.groupby("part")])
    assert set(found[found.whole.str.len() > 0].doc_id) == set(range(1, 300))


def test_a_document_that_starts_at_a_cut_of_a_longer_one(spark):
    rnd = random.Random(11)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(2_300_000))
    for at in (1_048_376, 1_048_376 - 20, 1_048_576 - 2000, 1_048_576 - 1990):
        rows = [(1, long[at : at + 2000]), (2, long)]
        got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        left = long[:at] + long[at + 2000 :]
        assert (got[2].n_removed, got[2].n_spans, got[1].n_removed) == (2000, 1, 0), at
        assert got[2].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_two_long_texts_that_first_agree_at_a_cut(spark):
    rnd = random.Random(12)
    shared = "".join(rnd.choice("abcdefghij ") for _ in range(1_500_000))
    heads = ["".join(rnd.choice(letters) for _ in range(1_048_376)) for letters in ("klmnop", "qrstuv")]
    rows = [(1, heads[0] + shared), (2, heads[1] + shared)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1_500_000}


def test_hot_first_bytes_with_surroundings_of_their_own(spark, monkeypatch):
    rnd = random.Random(13)
    line = "licensed under the terms of some well known licence"
    rows = [(i, "".join(rnd.choice("abcdef") for _ in range(60)) + line[: 30 + i % 22] + "".join(rnd.choice("ghijkl") for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][20:120]) for i in range(0, 400, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs).drop("kept_text", "had_text").collect()
    assert {tuple(r) for r in got} == brute_removal(rows)
