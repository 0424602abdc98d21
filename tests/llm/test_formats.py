"""Archives, chat formatting, packing and SentencePiece encoding: exact round trips and brute-force versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirewise.llm import chat, packing, pieces, warc
from quirewise.session import new_path


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back_resolved(spark):
    rows = [(9, "http://a/1", "same"), (3, "http://a/\r\n2 ü", "same"), (7, None, None), (8, "u", ""), (1, "u", "WARC/1.1\r\n\r\nalone\r\n\r\n")]
    rows += [(20 + i, "u", "copy") for i in range(40)] + [(60, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_type").repartition(4)
    headers = warc.write_pages(pages, new_path(spark, "w"), archive_bytes=400)
    assert headers.select("archive").distinct().count() > 4
    back = warc.read_resolved(warc.rewrite(warc.resolve(headers), new_path(spark, "r")))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()}
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        to = first[html or ""]
        assert got[i] == (len((html or "").encode()), digest(html), "response" if to == i else "revisit", None if to == i else to)
    assert len(got) == len(rows)
    assert warc.op2(pages.limit(0)).count() == 0


def test_repeated_and_missing_page_ids(spark):
    pages = spark.createDataFrame([(5, "u", "x"), (5, "u", "x"), (None, "u", "x"), (None, "u", None)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.op2(pages).collect())
    assert got == sorted([("5", "response", None, 1), ("5", "revisit", 5, 1), ("None", "revisit", 5, 1), ("None", "response", None, 0)], key=str)


def test_small_payloads_stay_responses(spark):
    headers = warc.write_pages(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), new_path(spark, "w"))
    to = {r.page_id: r.to_page for r in warc.resolve(headers, least=3).collect()}
    assert to == {1: None, 2: None, 3: None, 4: 3}


TOKENS = ["\\", "### ", "</turn>", "\n", "a", "#", ":", " ", "user", "é", "\r"]
TEXT = st.lists(st.sampled_from(TOKENS), max_size=12).map("".join) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_chat_reads_back_exactly(turns):
    formatted = "".join(chat.render(role, text) for role, text in turns)
    assert [t[:2] for t in chat.parse(formatted)] == turns


@pytest.mark.parametrize("bad", ["x", "### user:\nopen", "### user:\na ### b\n</turn>\n", "### user\n</turn>\n"])
def test_chat_outside_the_grammar_is_an_error(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_long_conversations_come_in_blocks(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"say {i} ### </turn> \\") for i in range(200)]
    rows += [(2, 1, None, None), (2, None, "assistant", "first"), (None, 0, "user", "no id"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as block").repartition(6)
    blocks = chat.format_conversations(table, block_chars=300)
    assert blocks.filter("conv_id = 1").count() > 10
    got = {r.conv_id: r for r in chat.read_back(blocks).collect()}
    assert set(got) == {1, 2, 3, None}
    assert {tuple(r) for r in chat.op9(table).filter("conv_id != -7 or conv_id is null").collect()} == {tuple(r) for r in got.values()}
    full = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:200])
    learned = "".join(t for _, _, r, t in rows[:200] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(full.encode()).hexdigest() and got[1].n_turns == 200
    assert got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[1].loss_chars == len(learned)
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\nfirst\n\n\n").hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256(b"tie atie b").hexdigest()
    assert chat.op9(table.limit(0)).count() == 1


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_documents_pack_tightly_and_whole(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    random.seed(5)
    texts = [None, "", " ", "  two  spaces \n\n x", "tab\t\n next", "é  　日本 😀", "<|endoftext|> in text", "'s don't", "word " * 9000, "x" * 70_000]
    texts += ["".join(random.choice([" ", "  ", "\n", "a", "bc", "1", "!", "é"]) for _ in range(random.randrange(1, 900))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "'l' as length").repartition(3)
    got = packing.op7(docs).toPandas()
    count = check_packing(got.to_dict("records"), 2048)
    assert count <= -(-got.length.sum() // 2048) + 1
    for doc, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        mine = got[got.doc_id == doc].sort_values("piece").drop_duplicates("piece")
        at = 0
        for row in mine.itertuples():
            assert row.start == at and row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            assert row.piece == 0 or row.length == 2048
            at += row.length
        assert at == len(ids) and len(mine) == -(-len(ids) // 2048)
    assert packing.op7(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=80), st.integers(0, 9))
def test_crossover_keeps_every_piece_once(length, seed):
    random_ = np.random.default_rng(seed)
    population = packing._start(length, 100, 3, random_)
    before = min(map(len, population))
    for packed in [*population, *(evolved := packing.evolve(list(population), length, 100, 5, random_))]:
        assert sorted(i for b in packed for i in b) == list(range(len(length)))
        assert all(sum(length[i] for i in b) <= 100 for b in packed)
    assert len(evolved[0]) <= before


@pytest.mark.parametrize("low, high, saved", [(300, 900, 25), (500, 1400, 5)])
def test_evolution_beats_its_start_population(spark, low, high, saved):
    lengths = np.random.default_rng(3).integers(low, high, 5000).tolist()
    blocks = spark.createDataFrame([(b, np.array(lengths[b::2], np.int32).tobytes()) for b in range(2)], "block long, lengths binary")
    for r in packing.evolved_blocks(blocks, 2, 2048).collect():
        bins = np.frombuffer(r.code, np.int32)
        fill = np.bincount(bins, np.array(lengths[r.block :: 2]))
        assert r.bins == len(fill) and fill.max() <= 2048 and fill.min() > 0
        assert r.least <= r.bins <= r.first_bins - saved * 0.4


def test_equal_and_extreme_lengths_reach_the_bound():
    random_ = np.random.default_rng(1)
    for length, bins in ([7] * 30, 3), ([100] * 9, 9), ([50] * 7, 4), ([1] * 250, 3), ([99, 1, 60, 40, 50, 50, 30], 4):
        packed = packing.best_fit_pairs(list(range(len(length))), length, 100, random_)
        assert sorted(i for b in packed for i in b) == list(range(len(length)))
        assert len(packed) == bins == packing.least_bins(length, 100)


def test_pieces_equal_the_library(spark):
    library = pieces._model(public_tokenizers.path(pieces.MODEL)).library
    random.seed(4)
    alphabet = ["the", "ing", " ", "   ", "▁", "=", "--", "日", "本", "0", "é", "①", "😀", "\n", "\t", " a", "<s>"]
    texts = [None, "", " ", "a", "▁", "x" * 5000, " " * 3000, "ab" * 2000, "\n" * 1500]
    texts += ["".join(random.choice(alphabet) for _ in range(random.randrange(1, 1500))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (1, "")], "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as ids").repartition(3)
    for size in (333, 16_384):
        got = pieces.encode(docs, chunk_chars=size).collect()
        assert len(got) == len(texts) + 1
        for row in got:
            text = texts[row.doc_id] or ""
            assert np.frombuffer(row.ids, np.uint32).tolist() == library.encode(text)
            assert row.decoded == text.replace("▁", " ") and row.n_ids == len(row.ids) // 4
    assert pieces.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["-" * 200, "=-" * 90, "thingsandotherthings" * 9, "日本é😀a" * 30, "aGVsbG8gd29ybGQ" * 12, "ab▁▁▁cd" * 25])
def test_states_walked_together_or_alone_end_alike(text):
    model = pieces._model(public_tokenizers.path(pieces.MODEL))
    entries = pieces._entries(model, text, 40)
    end = len(text) - 40
    together = model.walk(text, [(40 - b, 40 + a) for b, a in entries], end)
    for i, (b, a) in enumerate(entries):
        alone = model.lattice(text, 40 + a, text[40 - b : 40 + a], end)
        assert sorted(pieces._exits(alone, end)) == sorted(
            (end - at, place - end) for place, ways in together.items() for at, bits in ways.items() if at < end and bits >> i & 1
        )


def test_products_are_associative():
    random_ = np.random.default_rng(1)
    a, b, c = (np.unique(random_.integers(0, 6, (9, 2)), axis=0).astype(np.int32) for _ in range(3))
    one, two = pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c))
    assert one.tolist() == two.tolist()
