"""Operator 13 against the tokenizers library."""

import random

import pyarrow as pa
import pytest

from panelwise.llm.bpe import Encoder, Vocabulary, decode_ids, encode_texts, op13_bpe
from panelwise.llm.tokens import default_tokenizer
from panelwise.llm.words import buffer_of

from .brute import sha

ODD = [None, "", " ", "it's we'll 'tis !!'s x'S", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "\n\nb \t c", "xqzj" * 9, "é́ я 中文 x", "　 y", "😀👍🏽", "\x00\x1c\x85", "1234 ½ ٣", "!" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    with open(default_tokenizer(), encoding="utf-8") as f:
        return Encoder(Vocabulary(f.read()))


def ids_of(encoder, texts):
    ids, first = encoder.encode(*buffer_of(pa.array(texts, pa.large_string())))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def expected(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_texts_put_together_from_hard_parts(encoder, library):
    parts = [" ", "  ", "\n", "\t", "a", "xq", "zj", "'", "'s", "'re", "the", "!", "!!", "é", "я", "中", " ", "　", " ", "​", "😀", "1", "23", "½", "<|endoftext|>", "<|endo", "|>", "́", "ſ", "\x00", "\x1c", "\x85", "İ", "ا", "ค", "-", "᠎"]
    dice = random.Random(13)
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 30))) for _ in range(4000)]
    assert ids_of(encoder, texts) == expected(library, texts)


def test_long_fragments_without_a_cut(encoder, library):
    texts = ["a" * 50_000, " " * 30_000 + "b", "ab" * 20_000, "!" * 20_000 + "'s"]
    assert ids_of(encoder, texts) == expected(library, texts)
    assert all(len(piece) <= 64 for piece in encoder.cache)


def test_most_borders_of_words_are_certain_cuts(encoder):
    at, special = encoder.cuts(*buffer_of(pa.array(["the cat, or\nits 22 tails don't", "", "x<|endoftext|>y"], pa.large_string())))
    assert at.tolist() == [0, 3, 7, 8, 11, 15, 18, 24, 28, 30, 31, 44] and special == {31: 50256}


def test_documents_and_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: (r.ids, r.text) for r in decode_ids(encode_texts(df)).collect()}
    want = expected(library, ODD)
    assert got == {i: (want[i % len(ODD)], ODD[i % len(ODD)] or "") for i in range(2 * len(ODD))}
    assert encode_texts(df.limit(0)).count() == 0
    ids = spark.createDataFrame([(1, [464, 99999999, -1]), (2, None), (3, [222])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(ids).collect()} == {1: library.decode([464]), 2: "", 3: library.decode([222], skip_special_tokens=False)}


def test_query(spark, library):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    ids = dict(zip(docs, expected(library, list(docs.values()))))
    want = {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {tuple(r) for r in op13_bpe(spark, path).collect()} == want
    assert op13_bpe(spark, path).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Vocabulary('{"model": {"type": "WordPiece"}, "pre_tokenizer": null}')
