"""Token ids against the public libraries, and the round trip back to the text."""

import base64
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from ledgerfold.llm.bpe import DEFAULT_DIR, Encoder
from ledgerfold.llm.tokenize import encoded

PATH = f"{DEFAULT_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabularies here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(encoder, library, texts):
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, wanted):
        assert encoder.encode(text) == ids, text[:200]


ODD = [
    "", " ", "\n", "a", "don't we'll I've 'S 'll'd", "  two  spaces ", "tabs\t\t\nlines\r\n\r\n", "<|endoftext|> and <|endoftext|>", "x" * 3000, " " * 3000,
    "\n" * 2001 + "x", "ab" * 2000, "é日本語 ١٢٣ ½² 👩‍👩‍👧 ́", "\x1c\x1d\x85\xa0 ​\x00", "snake_case CamelCase HTTP2Server 3.14159e-10", "!!!???...===>>>", "﻿BOM",
]


def test_odd_texts(encoder, library):
    check(encoder, library, ODD)


def test_random_texts(encoder, library):
    r = random.Random(5)
    pools = ["ab cd'sll\n\t  1", "abcdefghij", "éüß日本 \n", "".join(map(chr, range(1, 0x250))), "{}()[];=+-_/\\\"' \nforifelse"]
    check(encoder, library, ["".join(r.choices(p, k=r.randint(1, 400))) for p in pools for _ in range(150)])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, library, text):
    check(encoder, library, [text])


def test_corpus(encoder, library):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    check(encoder, library, texts)


def test_round_trip(encoder):
    ranks = {i: base64.b64decode(a) for a, i in (line.split() for line in open(f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb"))}
    for text in ODD:
        assert b"".join(ranks[b"%d" % i] for i in encoder.encode(text)).decode() == text


def test_long_words_take_linear_time(encoder):
    """Words without any limit of length; a merge by merge search would take minutes."""
    import time

    r = random.Random(1)
    times = []
    for n in (50_000, 200_000):
        word = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        t = time.process_time()
        encoder.encode(word)
        times.append(time.process_time() - t)
    assert times[1] < 12 * times[0] + 1


def test_forgetting(encoder, monkeypatch):
    import ledgerfold.llm.bpe as bpe

    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "NEIGHBOURS", 3)
    small = Encoder(PATH)
    for text in ODD:
        assert small.encode(text) == encoder.encode(text)


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted(((r.doc_id, r.ids) for r in encoded(df).collect()), key=str)
    assert found == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (None, [64])], key=str)
    assert encoded(df.limit(0)).count() == 0
    named = df.select(df.doc_id.cast("string").alias("name"), df.text.alias("ids"))
    assert encoded(named, "name", "ids").schema.simpleString() == "struct<name:string,ids:array<int>>"
