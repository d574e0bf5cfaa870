"""Held-out texts that stand in a corpus, word for word or with other numbers, names and units.

Every text becomes a sequence of lower-cased words, maximal runs of ASCII letters and digits, and its template: numbers, names,
units and quantities are slots, for which a typed placeholder stands. Stretches of WINDOW words of held-out texts and corpus are
joined on the hash of their templates, and the slots decide what a joined pair is: the same values make it a copy; other
values that keep equal slots equal and unequal ones unequal, over all that two texts have in common at one shift, make
it the same question with other parameters.

There are two readings of a text. The plain one decides each word by itself, so equal words always have equal templates: no
copy is lost. The one by form looks at the text as it is written: a number with a decimal point or with commas before
thousands is one slot, a capitalised word is a name, and a word behind a number is a unit unless it is a function word or stands
in capitals. So no list of names is needed, and units needn't be listed. Other parameters are looked for in both readings.

A stretch with fewer than LITERALS words that are no slots has no template to tell it from others, such as a row of numbers; it
is keyed by its values too, so that it is found as a copy, and as nothing else.

The held-out side is hashed by the same tasks, into a table. What is broadcast of it is a bitmap of its keys, of bounded
size whatever the number of texts; the corpus is scanned once, and only stretches that pass the bitmap are joined with that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bitmaps
from ..session import BROADCAST_BYTES, staged, work_folder
from .batches import small_batches

WINDOW = 13
#: Words that are no slots, which a stretch must have to be found with other values in its slots.
LITERALS = 4
#: The bitmap of keys has from 2^MIN_BITS to 2^MAX_BITS bits: 32 MB at most. Beyond some ten million stretches more of the corpus passes it.
MIN_BITS, MAX_BITS = 20, 28

WORD = re.compile(rb"[A-Za-z0-9]+")
#: A number with a decimal point or with commas before thousands; dotted and listed numbers, as in 1.2.3 and 1,2,3, are several.
GROUPED = rb"(?:[0-9]{1,3}(?:,[0-9]{3}){1,9}(?:\.[0-9]+)?|[0-9]+\.[0-9]+)"
#: The words of the reading by form: such numbers are one word, with what follows them.
VALUE_WORD = re.compile(rb"(?<![0-9][.,])%s(?![0-9]|[.,][0-9])[A-Za-z0-9]*|[A-Za-z0-9]+" % GROUPED)
#: A number with up to five letters directly behind it.
QUANTITY = re.compile(rb"(?:%s|[0-9]+)[a-z]{1,5}" % GROUPED)

#: Units of measure, fixed values: words that are units wherever they stand.
UNITS = """
ns us ms s sec secs second seconds min mins minute minutes hour hours day days week weeks month months year years
b kb mb gb tb kib mib gib byte bytes bit bits
mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers
mg g kg gram grams kilogram kilograms tonne tonnes ounce ounces pound pounds litre litres liter liters ml
percent degree degrees volt volts watt watts hz khz mhz ghz px dollar dollars euro euros cent cents
""".split()  # fmt: skip

#: Number words of English, fixed values.
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
""".split()

#: Function words of English, fixed values: behind a number they are no unit.
FUNCTION_WORDS = """
a an the and or but nor so yet if then else when while as than that which who whose this these those it its he she they them his her their we you i
of in on at by to from with for into onto over under per is are was were be been has have had do does did can could will would shall should may might must not no
""".split()

#: Codes of slots; the codes of literal words are hashes above them.
NUMBER, QUANTITY_SLOT, UNIT, NAME, FIRST_LITERAL = 1, 2, 3, 4, 16
KINDS = "?NQUA"
#: What a word's form says.
CAPITAL, MAY_BE_UNIT = 1, 2

MULTIPLIER = 0x9E3779B97F4A7C15
#: What sets keys of one reading, and of stretches keyed by value, apart from others.
FORM_SALT, VALUE_SALT = 0xA5A5A5A5DEADBEEF, 0x5851F42D4C957F2D


NUMBERS = frozenset(w.encode() for w in NUMBER_WORDS)


def slot_kind(word: bytes, names: frozenset[bytes], units: frozenset[bytes]) -> int:
    """The kind of slot that a lower-case word fills by itself, whatever stands around it; 0 if none."""
    if word.isdigit() or word in NUMBERS:
        return NUMBER
    if word in units:
        return UNIT
    if word in names:
        return NAME
    if word[0] < 0x3A:
        return NUMBER if not word.isalnum() and word.replace(b".", b"").replace(b",", b"").isdigit() else QUANTITY_SLOT if QUANTITY.fullmatch(word) else 0
    return 0


class Coder(dict):
    """Words as they are written to places in arrays: template has the code of a slot or of the literal word, exact the code of
    the word itself, flags what its form says."""

    LIMIT = 1 << 19

    def __init__(self, names: Iterable[str], units: Iterable[str]):
        import numpy as np

        super().__init__()
        self.names, self.units = (frozenset(x.lower().encode() for x in xs) for xs in (names, units))
        self.function_words = frozenset(w.encode() for w in FUNCTION_WORDS)
        self.template, self.exact, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: bytes) -> int:
        import numpy as np
        import xxhash

        at = len(self)
        if at == len(self.template):
            self.template, self.exact, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.template, self.exact, self.flags))
        low = word.lower()
        capital = 0x41 <= word[0] <= 0x5A and word[1:].islower() and word.isalpha()
        self.flags[at] = CAPITAL * capital + MAY_BE_UNIT * (word.isalpha() and word == low and low not in self.function_words)
        exact = max(xxhash.xxh64_intdigest(low), FIRST_LITERAL)
        self.exact[at] = exact
        self.template[at] = slot_kind(low, self.names, self.units) or exact
        self[word] = at
        return at

    def forget(self) -> None:
        """Between batches: words are worked out anew once there are too many."""
        if len(self) > self.LIMIT:
            self.clear()


def hashes(codes, window: int):
    """The hash of each stretch of window codes, as uint64."""
    import numpy as np

    spread = (codes + np.uint64(1)) * np.uint64(MULTIPLIER)
    spread ^= spread >> np.uint64(29)
    n = len(codes) - window + 1
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = out * np.uint64(0xD6E8FEB86659FD93) + spread[k : k + n]
    return out ^ (out >> np.uint64(32))


def form_codes(places, coder: Coder):
    """The template by form: as the words' own, but that capitalised words are names, and words behind numbers units."""
    import numpy as np

    codes, flags = coder.template[places].copy(), coder.flags[places]
    codes[(flags & CAPITAL > 0) & (codes >= FIRST_LITERAL)] = NAME
    behind = (codes[:-1] == NUMBER) & (codes[1:] >= FIRST_LITERAL) & (flags[1:] & MAY_BE_UNIT > 0)
    codes[1:][behind] = UNIT
    return codes


class Stretches:
    """The stretches of texts: keys, places, words and kinds of slots. bits is a bitmap of wanted keys, of bits_log2 bits."""

    def __init__(self, window: int, literals: int, forms: bool, places: bool, names: Iterable[str] = (), units: Iterable[str] = UNITS, bits=None, bits_log2: int = 0):
        self.window, self.literals, self.forms, self.places = window, literals, forms, places
        self.coder, self.bits, self.bits_log2 = Coder(names, units), bits, bits_log2

    def of(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, bool, int, bytes, str]]:
        """(number of the text, key, by form, place, words, kinds) of each stretch that is wanted; each text's words are taken together
        with the others' in one array, and no stretch reaches over the end of a text. Without places, equal stretches
        of one text count once."""
        for form in (False, True) if self.forms else (False,):
            words, ends = [], []
            for text in texts:
                words += (VALUE_WORD if form else WORD).findall(text or b"")
                ends.append(len(words))
            yield from self._found(words, ends, form)
        self.coder.forget()

    def _found(self, words: list[bytes], ends: list[int], form: bool):
        import numpy as np

        n, w = len(words), self.window
        if n < w:
            return
        coder = self.coder
        places = np.fromiter(map(coder.__getitem__, words), np.int64, n)
        template = form_codes(places, coder) if form else coder.template[places]
        text = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        whole = text[: n - w + 1] == text[w - 1 :]
        literal = np.concatenate(([0], np.cumsum(template >= FIRST_LITERAL)))
        few = literal[w:] - literal[:-w] < self.literals
        keys = hashes(template, w)
        if few.any():
            keys = np.where(few, hashes(coder.exact[places], w) ^ np.uint64(VALUE_SALT), keys)
        if form:
            keys ^= np.uint64(FORM_SALT)
        if self.bits is not None:
            at = keys & np.uint64((1 << self.bits_log2) - 1)
            whole &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        starts, seen = [0, *ends], set()
        for i in np.flatnonzero(whole).tolist():
            own, t, key = b" ".join(words[i : i + w]).lower(), int(text[i]), int(keys[i])
            if not self.places:
                if (t, own) in seen:
                    continue
                seen.add((t, own))
            kinds = "".join("L" if c >= FIRST_LITERAL else KINDS[c] for c in template[i : i + w].tolist())
            yield t, key - (1 << 64) if key >> 63 else key, form, i - starts[t], own, kinds


FOUND = "key bigint, form boolean, pos bigint, words string, kinds string"


def scanned(rows: DataFrame, id_column: str, text_column: str, name: str, make, bitmap=None) -> DataFrame:
    """(name, FOUND) for every stretch that the Stretches of make(bits) find; bitmap is a broadcast bitmap of keys."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        stretches = make(None if bitmap is None else np.frombuffer(bitmap.value, np.uint8))
        for batch in batches:
            found = list(stretches.of(batch.column(1).to_pylist()))
            t, key, form, pos, words, kinds = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(t, pa.int64())), pa.array(key, pa.int64()), pa.array(form, pa.bool_()), pa.array(pos, pa.int64()),
                    pa.array([w.decode() for w in words], pa.string()), pa.array(kinds, pa.string()),
                ],
                names=[name, "key", "form", "pos", "words", "kinds"],
            )

    texts = rows.select(id_column, F.col(text_column).cast("binary").alias("_text"))
    return small_batches(texts).mapInArrow(run, f"`{name}` {kind}, {FOUND}")


def key_bitmap(held: DataFrame, n_keys: int) -> tuple[object, int]:
    """A broadcast bitmap in which the bits of the table's keys are set, and the logarithm of its size: some 64 bits for each key within
    the bounds. It is built by an aggregation over pieces of 4 KB, so what comes to the driver is at most its size."""
    log2 = max(MIN_BITS, min(MAX_BITS, (max(n_keys, 1) * 64 - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << log2) - 1).cast("bigint"))
    pieces = held.groupBy(bitmaps.bucket(place).alias("b")).agg(F.bitmap_construct_agg(bitmaps.bit(place)).alias("bits"))
    out = bytearray(1 << (log2 - 3))
    for b, bits in pieces.toLocalIterator():
        out[b * bitmaps.BYTES : (b + 1) * bitmaps.BYTES] = bits
    return held.sparkSession.sparkContext.broadcast(bytes(out)), log2


def joined(
    docs: DataFrame, items: DataFrame, id_column: str, text_column: str, item_column: str, passage_column: str, window: int, literals: int,
    forms: bool, names: Iterable[str], units: Iterable[str], broadcast_bytes: int,
) -> tuple[DataFrame, DataFrame]:
    """(doc, passage_no, form, shift, doc_words, item_words, kinds): stretches of documents and of held-out texts with equal
    templates, and (passage_no, item), the items of each class of equal passages.

    Null passages are left out. The join is proved by the literal words, so no hash can join what differs in them. shift is the
    stretch's place in the document less that in the passage; without forms, places aren't kept, and a document's equal
    stretches count once.
    """
    spark, names, units = docs.sparkSession, list(names), list(units)
    folder = work_folder(spark, "leak")
    passages = items.select(F.col(item_column).alias("item"), F.col(passage_column).cast("binary").alias("passage")).where(F.col("passage").isNotNull())
    members = passages.select(F.sha2("passage", 256).alias("passage_no"), "item").distinct()
    classes = passages.groupBy(F.sha2("passage", 256).alias("passage_no")).agg(F.any_value("passage").alias("passage"))
    make = lambda bits, log2=0: Stretches(window, literals, forms, forms, names, units, bits, log2)
    held = staged(scanned(classes, "passage_no", "passage", "passage_no", make), folder, "held")
    n, size = held.agg(F.count("*"), F.sum(F.octet_length("words") + 160)).first()
    bitmap, log2 = key_bitmap(held, n)
    here = scanned(docs, id_column, text_column, "doc", lambda bits: make(bits, log2), bitmap)
    h = held.select(F.col("key").alias("h_key"), F.col("form").alias("h_form"), F.col("pos").alias("h_pos"), F.col("words").alias("item_words"), F.col("kinds").alias("h_kinds"), "passage_no")
    if (size or 0) <= broadcast_bytes:
        h = F.broadcast(h)
    same = (F.col("key") == F.col("h_key")) & (F.col("form") == F.col("h_form")) & (F.col("kinds") == F.col("h_kinds"))
    pairs = here.join(h, same).where(F.col("words").eqNullSafe(F.col("item_words")) | same_literals(F.col("words"), F.col("item_words"), F.col("kinds"), literals))
    return pairs.select("doc", "passage_no", "form", (F.col("pos") - F.col("h_pos")).alias("shift"), F.col("words").alias("doc_words"), "item_words", "kinds"), members


def zipped(words: Column, others: Column, kinds: Column) -> Column:
    """The places of two stretches as an array of (d, h, k): word, other word, kind."""
    return F.zip_with(F.arrays_zip(F.split(words, " ").alias("d"), F.split(others, " ").alias("h")), F.split(kinds, ""), lambda p, k: F.struct(p["d"].alias("d"), p["h"].alias("h"), k.alias("k")))


def same_literals(words: Column, others: Column, kinds: Column, literals: int) -> Column:
    """Whether two stretches with equal kinds agree in all words that are no slots, and have enough of these."""
    enough = F.length(kinds) - F.length(F.replace(kinds, F.lit("L"), F.lit(""))) >= literals
    return enough & F.forall(zipped(words, others, kinds), lambda p: (p["k"] != "L") | (p["d"] == p["h"]))


def copies(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", passage_column: str = "passage", window: int = WINDOW, literals: int = LITERALS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, item), each pair once, of documents and held-out texts that share at least window consecutive words: of the stretches
    joined by their templates those whose slots have the same values.

    Null and empty texts, and passages of fewer words, share nothing. Texts are read whole, whatever their length. A copy is
    always found in the plain reading, so the other one isn't made.
    """
    pairs, members = joined(docs, items, id_column, text_column, item_column, passage_column, window, literals, False, (), UNITS, broadcast_bytes)
    found = pairs.where(F.col("doc_words") == F.col("item_words")).select("doc", "passage_no").distinct()
    return found.join(members, "passage_no").select(F.col("doc").alias(id_column), F.col("item").alias(item_column)).distinct()


def same_questions(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", passage_column: str = "passage", window: int = WINDOW, literals: int = LITERALS,
    names: Iterable[str] = (), units: Iterable[str] = UNITS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, item, n_changed, n_same): how many stretches of a document are an item's with other numbers, names or units, put in for
    the old ones consistently, and how many have the same ones; pairs without a changed stretch don't appear.

    Stretches at one shift between the two texts belong together: a value that is renamed in two ways among them, or two that
    become one, makes none of them count. Each pair is counted in the reading of the text, plain or by form, in which it has more
    changed stretches. A stretch counts at each place where it stands. names are further words that are names wherever they
    stand, as for texts in lower case; units are the words that are units anywhere.
    """
    pairs, members = joined(docs, items, id_column, text_column, item_column, passage_column, window, literals, True, names, units, broadcast_bytes)
    slots = F.filter(zipped(F.col("doc_words"), F.col("item_words"), F.col("kinds")), lambda p: p["k"] != "L")
    by = ["doc", "passage_no", "form"]
    # by document, passage and shift there are at most as many stretches as the passage has; the tasks that scan combine them first
    aligned = pairs.select(*by, "shift", slots.alias("s"), (F.col("doc_words") != F.col("item_words")).alias("changed")).groupBy(*by, "shift")
    aligned = aligned.agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"), F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_same"))
    count = lambda *parts: F.size(F.array_distinct(F.transform("s", lambda p: F.struct(p["k"].alias("k"), *[p[x].alias(x) for x in parts]))))
    consistent = aligned.where((count("d", "h") == count("d")) & (count("d", "h") == count("h")))
    counted = consistent.groupBy(*by).agg(F.sum("n_changed").alias("n_changed"), F.sum("n_same").alias("n_same")).where("n_changed > 0")
    best = counted.groupBy("doc", "passage_no").agg(F.max(F.struct("n_changed", "n_same")).alias("b"))
    # equal passages of several items were one class
    return best.join(members, "passage_no").select(F.col("doc").alias(id_column), F.col("item").alias(item_column), "b.n_changed", "b.n_same")
