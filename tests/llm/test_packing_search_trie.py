"""Packing, ranked search and the prefix trie against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute, helpers as H
from voxmill.llm import lexical, packing, texts, tokens, trie

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's o'clock, isn't it?", "a'sb .'s '' x'", "«Été»: Ça — naïve Ærø ÀÉÎ ß÷×", "é x̣ ́", "a b c　d", "<|endoftext|>X <|ENDOFTEXT|> <|x",
       "12,345.67e-8 v2.0_b", "ΑΣ ς İ ﬁ", "中文，标点。한국어", "x" * 3000, "\x00\x01 \x7f", "“Quote.” (yes!) no...\n\nnext\r\nline", "emoji 🙂🙂.", "_ __ a_b -a- b-", "AB'C D'E"]


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.DOCS).repartition(5)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_encoder_gives_the_tokenizers_ids(rows, tokenizer):
    rng = random.Random(3)
    signs = "aZé Éß'.,!?\"«»-_<|>/ \t\n12²́ ſ"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    every = [*(r[1] or "" for r in rows), *ODD, *made]
    column = pa.array(every, pa.large_string())
    encoder = tokens.Encoder(open(VOCABULARY).read(), remembered=50)
    expected = [e.ids for e in tokenizer.encode_batch(every, add_special_tokens=False)]
    for budget in (500, 1 << 20):
        for part in texts.slices(column, budget):
            ids, bounds, stops = encoder.encode(part)
            for i in range(len(part)):
                assert ids[bounds[i]:bounds[i + 1]].tolist() == expected[part.first + i], every[part.first + i]
            assert np.all(np.isin(stops, np.arange(len(ids) + 1)))


def test_sentences_end_at_stops_and_line_breaks():
    encoder = tokens.Encoder(open(VOCABULARY).read())
    part, = texts.slices(pa.array(["one two. three 4.5 five\nsix", "end"], pa.large_string()))
    ids, bounds, stops = encoder.encode(part)
    spelled = [encoder.tokenizer.id_to_token(int(i)) for i in ids]
    assert [spelled[s - 1] for s in stops] == [".</w>", "five</w>"]


def test_cuts_cost_least():
    rng = random.Random(5)
    for limit in (8, 16, 12):
        for _ in range(120):
            total = rng.randrange(1, 70)
            ends = np.array(sorted({*rng.sample(range(1, total + 1), min(total, rng.randrange(1, 6))), total}))
            inner = np.array(sorted(set(rng.sample(range(1, total + 1), min(total, rng.randrange(8)))) - set(ends.tolist())), dtype=np.int64)
            at, cost = packing.candidates(ends, inner, rng.choice([1, 3, limit]), rng.choice([0, 5]))
            assert np.diff(at).max() <= limit and at[0] == 0 and at[-1] == total
            cuts = packing.best_cuts(at, cost, limit)
            assert cuts[0] == 0 and cuts[-1] == total and max(np.diff(cuts)) <= limit
            price = (at.tolist(), cost.tolist(), limit, packing.SEQUENCE)
            assert brute.layout_cost(cuts, *price) == brute.best_layout(*price)


def check_pieces(pieces, rows, tokenizer, limit):
    expected = sorted(((r[0] is not None, r[0] or 0, tuple(e.ids) + (2,)) for r, e in zip(
        rows, tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True)))
    pieces = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    stream, lengths = [], {}
    for p in pieces:
        assert p["length"] > 0 and p["offset"] == lengths.get(p["sequence_id"], 0)
        lengths[p["sequence_id"]] = p["offset"] + p["length"]
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        if p["start"] == 0:
            stream.append((p["doc_id"] is not None, p["doc_id"] or 0, ()))
        assert (p["doc_id"] is not None, p["doc_id"] or 0) == stream[-1][:2] and p["start"] == len(stream[-1][2])
        stream[-1] = (*stream[-1][:2], stream[-1][2] + tuple(ids))
        if p["start"] + p["length"] == p["doc_tokens"]:
            assert len(stream[-1][2]) == p["doc_tokens"]
    key = lambda x: (x[0], x[1], np.array(x[2], "<u2").tobytes())
    assert stream == sorted(expected, key=key)
    assert max(lengths.values()) <= limit
    return sum(0 if n & (n - 1) == 0 else limit - n for n in lengths.values()) / sum(lengths.values())


@pytest.mark.parametrize("limit, horizon, block", [(4096, packing.HORIZON, packing.BLOCK_BYTES), (256, 600, packing.BLOCK_BYTES), (256, 600, 900)])
def test_packing(spark, docs, rows, tokenizer, limit, horizon, block, monkeypatch):
    monkeypatch.setattr(packing, "HORIZON", horizon)
    whole = packing.blocks_of
    monkeypatch.setattr(packing, "blocks_of", lambda d: whole(d, block))
    found = [r.asDict() for r in packing.pack(docs.withColumn("ids", F.lit(1)).withColumn("block", F.lit("x")), VOCABULARY, limit).collect()]
    assert check_pieces(found, rows, tokenizer, limit) < 0.05
    again = packing.pack(docs.repartition(3, "text"), VOCABULARY, limit).collect()
    assert sorted(map(str, found)) == sorted(str(r.asDict()) for r in again)


def test_packing_of_nothing_and_of_odd_texts(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], H.DOCS), VOCABULARY).count() == 0
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (None, ""), (5, ODD[5])]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, 64).collect()
    check_pieces([r.asDict() for r in found], rows, tokenizer, 64)


def test_blocks_follow_the_order_of_ids(spark):
    rng = random.Random(9)
    ids = [*range(-5, 60), *(rng.randrange(1 << 40, 1 << 41) for _ in range(50)), -(1 << 63), (1 << 63) - 1] + [77] * 300 + [None] * 40
    made = spark.createDataFrame([(i, "x" * rng.randrange(200)) for i in ids], "doc_id long, text string")
    blocks = packing.blocks_of(made, 1000)
    rest = np.array(sorted(i for i in ids if i is not None and i != 77))
    at = blocks.of(rest, np.zeros(len(rest), bool), np.zeros(len(rest), np.int64))
    assert np.all(np.diff(at) >= 0)
    hot = blocks.of(np.full(50, 77), np.zeros(50, bool), np.arange(50))
    assert len(set(hot.tolist())) > 20 and not set(hot.tolist()) & set(at[rest != 77].tolist()) - {hot.min()}
    assert blocks.of(np.array([0]), np.array([True]), np.array([0]))[0] == 0
    size = {}
    for b, n in zip(at.tolist(), [1] * len(at), strict=True):
        size[b] = size.get(b, 0) + n
    assert max(size.values()) < 150
    assert packing.blocks_of(made.where("false")).first.size == 0
    assert [b for b, in zip(packing.blocks_of(made.repartition(7), 1000).first.tolist())] == blocks.first.tolist()


ITEMS = [(1, "Alpha3 beta, unseenword gamma7."), (2, "the"), (3, None), (4, ""), (5, "über niño été über"), (None, "alpha1 alpha2"), (1, "delta9 alpha3"), (6, " ".join(H.WORDS)), (7, "x")]


@pytest.mark.parametrize("index_bytes, cells", [(lexical.INDEX_BYTES, lexical.CELLS), (20, 3)])
def test_ranked_search(spark, docs, rows, index_bytes, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    found = lexical.rank(docs.withColumn("terms", F.lit(0)).withColumn("part", F.lit("y")), items, index_bytes=index_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    H.same(found.collect(), brute.ranked([r[:2] for r in rows], ITEMS))
    H.same(lexical.rank(docs, items, top=3, index_bytes=index_bytes).collect(), brute.ranked([r[:2] for r in rows], ITEMS, 3))


def test_ranked_search_of_nothing(spark, docs):
    no_items, no_docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], H.DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank(docs, no_items).count() == lexical.rank(no_docs, items).count() == 0
    only_signs = spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string")
    assert lexical.rank(only_signs, items).count() == 0


def test_automaton_counts_every_occurrence():
    rng = random.Random(4)
    made = ["".join(rng.choice("aAb é.\n") for _ in range(rng.randrange(200))) for _ in range(50)] + ["", "a", "a a a", "éa"]
    terms = lexical.Terms({1: {b"a", b"ab", "é".encode()}, 2: {b"aa", "éa".encode()}})
    automaton = terms.automaton()
    for part in texts.slices(pa.array(made, pa.large_string()), 700):
        n, text, term, tf = lexical.counts(part, automaton, len(terms.terms))
        got = dict(zip(zip(text.tolist(), term.tolist()), tf.tolist()))
        for i in range(len(part)):
            own = H.PLAIN.findall(H.lower(made[part.first + i]))
            assert n[i] == len(own)
            for k, t in enumerate(terms.terms):
                assert got.get((i, k), 0) == own.count(t.decode())


def test_lengths_beyond_64_bits():
    n = np.array([1, 1 << 40])
    assert lexical.lengths(n, 1 << 34, 1 << 60).tolist() == [10 + 90 * k * (1 << 34) // (1 << 60) for k in (1, 1 << 40)]


TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed, n, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in (*range(n), *(100 * k + rng.randrange(1, 100) for k in range(3, 12)), 1 << 40, -250, -200):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 5]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "é🙂", *"abc"[:words]])))
    hot = [(c, t, "user", "same") for c in range(600, 660) for t in range(3)]
    return [*rows, *hot, rows[0], rows[0], (None, 1, "user", "lost"), (7, None, None, None)]


@pytest.mark.parametrize("longest, band, step, hot", [(7, trie.BAND_BITS, trie.STEP_BITS, trie.HOT), (7, 1, 2, 1), (60, 2, 3, 2), (60, 1, 1, 0)])
def test_prefix_trie(spark, longest, band, step, hot, monkeypatch):
    for name, value in (("BAND_BITS", band), ("STEP_BITS", step), ("HOT", hot), ("ID_BITS", step)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(longest, 240 if longest < 10 else 30, longest)
    made = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(0)).repartition(5)
    found = trie.prefix_trie(made)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    H.same(found.collect(), brute.trie(rows))


def test_prefix_trie_of_nothing_and_of_one_long_conversation(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(7, t, "user", f"{t % 5}") for t in range(2500)]
    H.same(trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect(), brute.trie(rows))


def test_crc32_of_pieces_is_that_of_their_ids(spark, docs):
    for r in packing.pack(docs, VOCABULARY).select("ids", F.crc32("ids").alias("crc")).limit(5).collect():
        assert r["crc"] == zlib.crc32(r["ids"])
