"""Text statistics against a plain reading of the rules, and merging in any grouping."""

import random

import pytest

from ledgerfold.llm import quality
from ledgerfold.llm.quality import COUNTS, Partial, Words, chunks, closed, merge, partial

COMMON = ["the", "of", "and", "a", "don't", "to"]


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split("[ \t\r\n]+", text) if w]
    lines = [x for x in (p.strip(" \t\r") for p in text.split("\n")) if x]
    az = "abcdefghijklmnopqrstuvwxyz"

    def core(w):
        w = w.lower()
        while w and w[0] not in az:
            w = w[1:]
        while w and w[-1] not in az:
            w = w[:-1]
        return w

    symbols = sum("!" <= c <= "~" and not c.isalnum() for c in text)
    return (sum(map(len, words)), symbols, len(words), sum(core(w) in COMMON for w in words), len(lines), sum(x[-1] in ".!?" for x in lines))


TEXTS = [
    "", " ", "\n", "\n\n", "the", "The", "the,", '"the"', "th-e", "don't", "don’t", "the of\nand.", "a.\r\nb!\r\n\r\n", "x \t.\n?", "\x0bthe\x0c of", "thé the of",
    "İa KK the", "...!!!\n---\n", "the" + "-" * 50, "-" * 50 + "the", "the" + "-" * 50 + "x", "1. The end.  \n2) of!", "word" * 100 + " the\n", "日本語 の 。\n the!",
]


def random_texts(n, seed=3):
    r = random.Random(seed)
    pieces = ["the", "The", "of", "don't", "x", "-", "!", ".", "?", " ", " ", "  ", "\n", "\t", "\r", "é", "日", "abcdefgh", "1", "\x0b"]
    return ["".join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_of_any_size(size):
    words = Words(COMMON)
    for text in TEXTS + random_texts(400):
        p = Partial()
        for piece in chunks(text.encode(), size):
            p = merge(p, partial(piece, words), words)
        assert closed(p, words) == brute(text), repr(text)


def test_merge_is_associative():
    words = Words(COMMON)
    r = random.Random(1)
    for text in random_texts(300, 7):
        parts = [partial(c, words) for c in chunks(text.encode(), r.randint(1, 6))]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [merge(parts[i], parts[i + 1], words)]
        assert closed(parts[0] if parts else Partial(), words) == brute(text), repr(text)


def test_open_words_are_bounded():
    words = Words(COMMON)
    p = Partial()
    for _ in range(50):
        p = merge(p, partial(b"-" * 1000 + b"x" * 1000, words), words)
    assert len(p.head) < 40 and closed(p, words)[2:4] == (1, 0)


@pytest.mark.parametrize("spread,chunk,fan", [(1 << 17, 1 << 15, 256), (10, 4, 2), (0, 1, 3)])
def test_rows(spark, spread, chunk, fan):
    """The same counts whether texts are worked out in place or spread; nulls, repeats and null ids too."""
    texts = [*TEXTS, *random_texts(30), None, "the " * 500 + "\n" + "of. \n" * 100]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(1, TEXTS[1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    found = sorted(((r.doc_id, *[r[c] for c in COUNTS]) for r in quality.counts(df, COMMON, spread=spread, chunk=chunk, fan=fan).collect()), key=str)
    assert found == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)


def test_prose(spark):
    prose = "The end of the day and the start of a night. " * 5
    cases = {
        1: prose,
        2: None,
        3: "",
        4: "the of and\n" * 20,  # three words a line
        5: "xyz abc word here " * 20,  # no common words
        6: "The of and a to. " * 7 + "the of and a",  # 39 words
        7: "the of and {} [] ;; " * 20 + ".",  # symbols, but it ends well and its words are of good length
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    found = quality.with_ratios(quality.counts(df, COMMON))
    assert {r.doc_id for r in found.where(quality.is_prose()).collect()} == {1}
    assert found.where("doc_id = 3").first().mean_word_length is None
    assert quality.counts(df.limit(0), COMMON).count() == 0
    assert quality.counts(df, []).agg({"n_common": "sum"}).first()[0] == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_words_from_a_table(spark, broadcast_bytes):
    """A list of common words that is broadcast, and one that is joined, give the same."""
    texts = ["the end of a day", "", None, "(the) don't THE", "x " * 30 + "of", "the\nend.\n", "the end of a day"]
    docs = spark.createDataFrame([(None if i == 3 else i % 6, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words = spark.createDataFrame([(w, 1) for w in [*COMMON, None, "", "the"]], "word string, rank_no bigint")
    got = [tuple(r) for r in quality.counts_by_words(docs, words, broadcast_bytes=broadcast_bytes).collect()]
    assert sorted(got, key=str) == sorted([(None if i == 3 else i % 6, *brute(t)) for i, t in enumerate(texts)], key=str)
    assert quality.counts_by_words(docs.limit(0), words, broadcast_bytes=broadcast_bytes).count() == 0


def test_words_of_long_texts():
    text = (b"ab cd\x0bef " * 5000)[:-1]
    assert list(quality.words_of(text, 7)) == list(quality.words_of(text)) == text.translate(quality.KEEP_WHOLE).split()
