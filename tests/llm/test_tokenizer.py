import random

import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm.tokenizer import Decoder, Encoder, MergeList, Transducer, decode_corpus, default_path, encode_corpus, count_tokens

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "aa", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'s", "'ll", "é", "​", "中文", "。", "1", "23", "\U0001f600", "-", "=", "ÃÂ", "==", "_", "<|endoftext|>", "\0", "ø", "ا", "न"]


@pytest.fixture(scope="module")
def merges():
    return MergeList(default_path())


@pytest.fixture(scope="module")
def encoder(merges):
    return Encoder(merges)


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_public_tokenizer_in_any_parts(encoder, merges, public):
    rng = random.Random(3)
    for k in range(1500):
        s = "".join(rng.choice(PIECES) * rng.choice([1, 1, 1, 2, 5, 90 if k % 20 == 0 else 3]) for _ in range(rng.randrange(0, 40)))
        want = public(s)
        assert encoder.encode(s) == want
        parts, at = [], 0
        while at < len(s):
            n = rng.randrange(1, 9)
            parts.append(s[at : at + n])
            at += n
        assert [x for y in encoder.stream(parts) for x in y] == want
        d = Decoder(merges)
        assert "".join(d.feed([i]) for i in want) + d.finish() == s


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, public, merges, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == public(text)


def test_transducer_emits_early_and_forgets(merges, public):
    t, n, most = Transducer(merges), 0, 0
    word = "abcdefgh" * 20_000
    out = []
    for k in range(0, len(word), 100):
        out += t.feed(word[k : k + 100].encode())
        most = max(most, len(t.last))
    assert most < 20 * merges.lookahead and out + t.finish() == public(word)


def test_very_long_texts(encoder, public):
    for s in ("a" * 150_000, " " * 70_001 + "x", "中文字符" * 20_000, "x y\n" * 40_000, "=-" * 40_000):
        assert encoder.encode(s) == public(s)


def test_corpus(spark, public):
    data = [(1, "Hello world", 5), (2, "", 5), (3, None, 5), (4, " \n", 5), (5, "<|endoftext|>", 5), (6, "Hello world", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df).collect()}
    assert got == {i: public(t) if t else [] for i, t, _ in data}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()} == {i: t or "" for i, t, _ in data}
    assert encode_corpus(df.where("false")).isEmpty()
