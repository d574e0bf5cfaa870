"""Statistics of a text that tell natural prose from lists, tables and junk.

A text is cut into chunks. Each chunk gives partial counts and the state at its two ends: the piece of a word that
stands open there, and whether the open line has words and how it ends. Two neighbours' partials merge into one of the same
form, so the counts of a whole text come from its chunks' in any grouping that keeps their order. Texts up to
SPREAD bytes are worked out where they are read; longer ones have their chunks spread over the cluster, and their
partials merged in two levels.

Words are maximal runs of characters other than space, tab, CR and LF. Lines are the pieces between LFs that aren't
empty once space, tab and CR are taken off their ends. A symbol is an ASCII character from ! to ~ that is neither letter nor
digit. A word is common if, in lower case and freed at both ends of all but a to z, it is in a given list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..session import BROADCAST_BYTES, staged, work_folder
from .batches import small_batches

CHUNK, SPREAD = 1 << 15, 1 << 17
#: Partials that one group merges at the first level. A text has at most 2^31 bytes, so the second level merges at most as many.
FAN = 256

SPACES = b" \t\r\n"
SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Taken out, one byte is left for each character that isn't white space: no spaces, and none of the bytes that continue a character.
NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))
#: bytes.split() also cuts at VT and FF, which belong to words here.
KEEP_WHOLE = bytes.maketrans(b"\x0b\x0c", b"\x01\x01")
CORE = re.compile("[a-z](?:.*[a-z])?", re.DOTALL)


class Partial(NamedTuple):
    """What a stretch of text holds, apart from the open word and the open line at either end."""

    chars: int = 0
    symbols: int = 0
    words: int = 0  # closed at both ends
    common: int = 0
    cut: bool = False  # whether the stretch has white space at all
    head: str | None = None  # the word open at the start, as open_word() keeps it; all of it if not cut
    tail: str | None = None  # the word open at the end
    lines: int = 0  # closed at both ends
    ended: int = 0
    broken: bool = False  # whether the stretch has an LF
    head_line: int = 0  # of the line open at the start: 0 no words, 1 words, 2 words and an end mark last; all of it if not broken
    tail_line: int = 0


PARTIAL = "chars bigint, symbols bigint, words bigint, common bigint, cut boolean, head string, tail string, lines bigint, ended bigint, broken boolean, head_line int, tail_line int"
FIELDS = list(Partial._fields)


class Words(dict):
    """Whether a word, given as bytes, is common."""

    LIMIT = 300_000

    def __init__(self, common: Iterable[str]):
        super().__init__()
        self.list = frozenset(common)
        self.longest = max(map(len, self.list), default=0)

    def __missing__(self, word: bytes) -> bool:
        core = CORE.search(word.decode("utf-8", "replace").lower())
        known = core is not None and core.group() in self.list
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = known
        return known

    def open_word(self, text: str) -> str:
        """As much of an open word as its commonness can depend on: what stands before, from and after its first and last
        letter, each cut where it is longer than any word of the list, and so too long whatever follows."""
        text, most = text.lower(), self.longest + 1
        core = CORE.search(text)
        if core is None:
            return text[:most]
        body = core.group() if len(core.group()) < most else "a" * most
        return text[: core.start()][:most] + body + text[core.end() :][:most]


def line_state(line: bytes) -> int:
    line = line.strip(b" \t\r")
    return 0 if not line else 2 if line.endswith((b".", b"!", b"?")) else 1


def partial(data: bytes, words: Words) -> Partial:
    """The partial of one chunk."""
    chars = len(data.translate(None, NOT_COUNTED))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    pieces = data.split(b"\n")
    states = list(map(line_state, pieces))
    line = dict(broken=len(states) > 1, head_line=states[0], tail_line=states[-1] if len(states) > 1 else 0)
    inner = states[1:-1]
    line |= dict(lines=len(inner) - inner.count(0), ended=inner.count(2))
    tokens = data.translate(KEEP_WHOLE).split()
    if not tokens:
        return Partial(0, 0, 0, 0, bool(data), **line)
    starts, ends = data[0] not in SPACES, data[-1] not in SPACES
    if starts and ends and len(tokens) == 1:
        return Partial(chars, symbols, 0, 0, False, words.open_word(data.decode("utf-8", "replace")), None, **line)
    head = tail = None
    if starts:
        head = words.open_word(tokens.pop(0).decode("utf-8", "replace"))
    if ends:
        tail = words.open_word(tokens.pop().decode("utf-8", "replace"))
    return Partial(chars, symbols, len(tokens), sum(map(words.__getitem__, tokens)), True, head, tail, **line)


def merge(a: Partial, b: Partial, words: Words) -> Partial:
    """The partial of two neighbouring stretches; associative."""
    count, common = a.words + b.words, a.common + b.common
    left = a.tail if a.cut else a.head  # the word open where they meet, from the left
    met = left if b.head is None else b.head if left is None else words.open_word(left + b.head)
    head, tail = a.head, b.tail
    if a.cut and b.cut:
        if met is not None:
            count, common = count + 1, common + words[met.encode()]
    elif a.cut:
        tail = met
    elif b.cut:
        head = met
    else:
        head = met
    lines, ended = a.lines + b.lines, a.ended + b.ended
    line = (b.head_line or a.tail_line) if a.broken else (b.head_line or a.head_line)
    head_line, tail_line = a.head_line, b.tail_line
    if a.broken and b.broken:
        lines, ended = lines + (line > 0), ended + (line == 2)
    elif a.broken:
        tail_line = line
    else:
        head_line = line
    return Partial(a.chars + b.chars, a.symbols + b.symbols, count, common, a.cut or b.cut, head, tail, lines, ended, a.broken or b.broken, head_line, tail_line)


def closed(p: Partial, words: Words) -> tuple[int, int, int, int, int, int]:
    """(chars, symbols, words, common, lines, ended) of a whole text, its ends closed."""
    open_words = [w for w in (p.head, p.tail) if w is not None]
    open_lines = [s for s in (p.head_line, p.tail_line) if s]
    return (
        p.chars,
        p.symbols,
        p.words + len(open_words),
        p.common + sum(words[w.encode()] for w in open_words),
        p.lines + len(open_lines),
        p.ended + open_lines.count(2),
    )


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """data in pieces of about size bytes; no character is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and end - at > 0 and 0x80 <= data[end] < 0xC0:
            end += 1
        yield data[at:end]
        at = end


def whole(data: bytes, words: Words) -> tuple[int, int, int, int, int, int]:
    p = Partial()
    for piece in chunks(data):
        p = merge(p, partial(piece, words), words)
    return closed(p, words)


COUNTS = ["n_chars", "n_symbols", "n_words", "n_common", "n_lines", "n_ended"]


def counts_by_words(docs: DataFrame, common: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """counts() with the common words in the first column of a table, of any size; null and empty words are left out.

    A list that may be broadcast goes to every task. A larger one is joined: each text gives its different words with how
    often it has them, in one task per text, and those that the list has are added up by text.
    """
    words = common.select(F.col(common.columns[0]).alias("_word")).where("_word <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("_word") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return counts(docs, [r[0] for r in words.toLocalIterator()], id_column, text_column)
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text_column).cast("binary").alias("_text"))
    keyed = staged(keyed, work_folder(docs.sparkSession, "quality"), "texts")  # the numbers must stay as they are

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, text in zip(*[c.to_pylist() for c in batch.columns]):
                found: dict[str, int] = {}
                for word in words_of(text or b""):
                    core = CORE.search(word.decode("utf-8", "replace").lower())
                    if core is not None:
                        found[core.group()] = found.get(core.group(), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["_row", "_core", "_n"])

    of_text = small_batches(keyed.select("_row", "_text")).mapInArrow(run, "_row bigint, _core string, _n bigint")
    known = of_text.join(words, F.col("_core") == F.col("_word"), "left_semi").groupBy("_row").agg(F.sum("_n").alias("_common"))
    rest = counts(keyed, [], "_row", "_text").drop("n_common").join(known, "_row", "left").join(keyed.select("_row", "_id"), "_row")
    return rest.select(F.col("_id").alias(id_column), *[F.coalesce("_common", F.lit(0).cast("bigint")).alias(c) if c == "n_common" else F.col(c) for c in COUNTS])


def words_of(data: bytes, piece: int = SPREAD) -> Iterator[bytes]:
    """The words of a text, taken a piece at a time that ends at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield from data[at:end].translate(KEEP_WHOLE).split()
        at = end


def counts(docs: DataFrame, common: Iterable[str], id_column: str = "doc_id", text_column: str = "text", spread: int = SPREAD, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(id, COUNTS) for every row. Null, empty and blank texts have counts of 0; repeated rows and null ids stay as they are.

    n_chars counts the characters in words. common is held by every task, so it must be a short list.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    lexicon = sorted({w for w in common if w})
    docs = docs.select(id_column, F.col(text_column).cast("binary").alias("_text"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    out = f"`{id_column}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def here(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words(lexicon)
        for batch in batches:
            rows = [whole(x or b"", words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]], names=[id_column, *COUNTS])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                for no, piece in enumerate(chunks(text, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([doc], batch.schema.field(1).type), pa.array([no], pa.int64()), pa.array([piece], pa.binary())], names=["_key", id_column, "_no", "_piece"])

    names = ["_key", id_column, "_no"]

    def count_pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words(lexicon)
        for batch in batches:
            made = [partial(x, words)._asdict() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, PARTIAL_TYPE())], names=[*names, "p"])

    def merge_groups(last: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            words = Words(lexicon)
            for batch in batches:
                done = []
                for group in batch.column(3).to_pylist():
                    p = Partial()
                    for x in sorted(group, key=lambda x: x["_no"]):
                        p = merge(p, Partial(**x["p"]), words)
                    done.append(closed(p, words) if last else p._asdict())
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * 6)]], names=[id_column, *COUNTS])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, PARTIAL_TYPE())], names=[*names, "p"])

        return run

    small = small_batches(docs.where(size <= spread)).mapInArrow(here, out)
    keyed = docs.where(size > spread).select(F.monotonically_increasing_id().alias("_key"), id_column, "_text")
    pieces = small_batches(keyed).mapInArrow(cut, f"_key bigint, `{id_column}` {kind}, _no bigint, _piece binary").repartition("_key", "_no")
    row = f"_key bigint, `{id_column}` {kind}, _no bigint, p struct<{PARTIAL.replace(' ', ':').replace(',:', ',')}>"
    level0 = small_batches(pieces).mapInArrow(count_pieces, row)
    grouped = lambda df, no: df.groupBy("_key", id_column, no.alias("_g")).agg(F.collect_list(F.struct("_no", "p")).alias("ps"))
    level1 = grouped(level0, F.floor(F.col("_no") / fan)).mapInArrow(merge_groups(False), row)
    large = grouped(level1, F.lit(0).cast("bigint")).mapInArrow(merge_groups(True), out)
    return small.unionByName(large)


def PARTIAL_TYPE():
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    return pa.struct([(f, kinds[k]) for f, k in (x.split(" ") for x in PARTIAL.split(", "))])


def with_ratios(df: DataFrame) -> DataFrame:
    """COUNTS with the ratios; a ratio with nothing below the line is null."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return df.withColumns(
        {
            "mean_word_length": ratio("n_chars", "n_words"),
            "words_per_line": ratio("n_words", "n_lines"),
            "symbol_ratio": ratio("n_symbols", "n_chars"),
            "ended_ratio": ratio("n_ended", "n_lines"),
            "common_ratio": ratio("n_common", "n_words"),
        }
    )


def is_prose() -> Column:
    """Natural prose, from COUNTS, in whole numbers so that no ratio at a limit is rounded to the wrong side."""
    c = {n: F.col(n) for n in COUNTS}
    length = (c["n_chars"] >= 3 * c["n_words"]) & (c["n_chars"] <= 7 * c["n_words"])
    plain = c["n_symbols"] * 10 <= c["n_chars"]
    ended = c["n_ended"] * 2 >= c["n_lines"]
    signs = length.cast("int") + plain.cast("int") + ended.cast("int")
    return (c["n_words"] >= 40) & (c["n_words"] >= 4 * c["n_lines"]) & (c["n_common"] * 10 >= 3 * c["n_words"]) & (signs >= 2)
