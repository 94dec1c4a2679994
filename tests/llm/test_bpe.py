import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from grovelake.llm.bpe import Vocabulary, bpe_decode, bpe_encode

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    v = Vocabulary(PATH)
    return v, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_same_as_the_library(pair):
    v, library = pair
    rng = random.Random(1)
    letters = "aabbcd eéñ  \t\n\r\x1c\x85\xa0　's'll12٣Ⅷ²漢字🙂!?..--_​́<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(40)] + ["".join(rng.choice("aeinrst") for _ in range(300)) for _ in range(50)]
    cut = [regex.findall(P.PATTERN, t) for t in texts]
    known = v.encode_words(w.encode() for words in cut for w in words)
    for t, words in zip(texts, cut, strict=True):
        got = b"".join(known[w.encode()] for w in words)
        assert ids(got) == library.encode_ordinary(t), t
        assert v.decode(got) == t.encode()


def test_a_merge_that_opens_an_earlier_one_falls_back_on_the_definition():
    v = Vocabulary.__new__(Vocabulary)
    v.ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"bc": 5, b"abc": 2, b"cd": 7}
    v.tokens = {r: t for t, r in v.ranks.items()}
    v.single, v.joined = [1000 + b for b in range(256)], {}
    words = [b"abcd", b"bcabc", b"abcabcd", b"cd"]
    assert v.replay(words) == [v.one_by_one(w) for w in words]


def test_operator(spark, pair):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, 8), (3, "", 9), (None, "x " * 700_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe_decode(bpe_encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((d or 0, len(pair[1].encode_ordinary(t or ""))) for d, t, _ in rows)
    want = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows}
    assert {hashlib.sha256(r.decoded).hexdigest() for r in got} == want
    assert bpe_encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_two_pairs_of_one_rank_join_from_the_left():
    v = Vocabulary.__new__(Vocabulary)
    v.ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 1, b"ba": 2, b"aba": 5}
    v.tokens = {r: t for t, r in v.ranks.items()}
    v.single, v.joined = [1000 + b for b in range(256)], {}
    words = [bytes(w) for n in range(2, 8) for w in itertools.product(b"ab", repeat=n)]
    assert v.replay(words) == [v.one_by_one(w) for w in words]


def test_small_blocks_and_clashing_names(spark, pair):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta Gamma dé 漢字 1234 !!".split()) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = [(i, t, b"x", i * 2, "w") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, block long, word string").repartition(3)
    got = bpe_encode(df, PATH, P.PATTERN).collect()
    assert {(r.doc_id, r.block, r.word, tuple(ids(r.ids))) for r in got} == {(i, i * 2, "w", tuple(pair[1].encode_ordinary(t))) for i, t in enumerate(texts)}
    assert bpe_decode(spark.createDataFrame([(1, None), (2, b"")], "k int, ids binary"), PATH).select("decoded").distinct().first()[0] == b""


def test_a_dictionary_of_more_words_than_two_bytes_count(spark, pair):
    text = " ".join(f"{i:05x}" for i in range(70_000))
    got = bpe_encode(spark.createDataFrame([(1, text), (2, "05 " + text[:9])], "doc_id long, text string").coalesce(1), PATH, P.PATTERN).collect()
    assert {r.doc_id: ids(r.ids) for r in got} == {1: pair[1].encode_ordinary(text), 2: pair[1].encode_ordinary("05 " + text[:9])}


def test_ids_and_bytes_from_one_worker(spark, pair):
    rows = [(1, "hello world", b"x"), (2, None, None), (3, "", b""), (None, "漢字 " * 300_000, None), (1, "hello world", b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded binary")
    got = bpe_encode(df, PATH, P.PATTERN, decoded="decoded")
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "n_tokens"]
    want = bpe_decode(bpe_encode(df, PATH, P.PATTERN), PATH)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))
    assert bpe_encode(df.limit(0), PATH, P.PATTERN, decoded="decoded").count() == 0
