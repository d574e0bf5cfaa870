"""Held-out passages in documents, against plain Python."""

import random
import re

import pytest

from ledgerfold.llm import leak

DOCS, ITEMS = "doc_id bigint, text string, key string, words string", "item_id string, passage string, item string"


def words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


def brute(docs, items, window=13):
    grams = lambda t: {tuple(w[i : i + window]) for w in [words(t)] for i in range(len(w) - window + 1)}
    held = [(i, grams(p)) for i, p in items]
    return {(d, i) for d, t in docs for g in [grams(t)] for i, h in held if g & h}


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "k", "w") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "i") for x in items], ITEMS)
    rows = [tuple(r) for r in leak.copies(d, i, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["sum", "7", "42", "alice", "bob", "km", "5km", "of", "tree", "node", "x1", "é", "Kelvin"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [("i%d" % i, text(r.randint(5, 40))) for i in range(12)] + [("none", None), ("empty", ""), ("again", "")]
    items.append(("twin", items[0][1]))
    docs = []
    for i in range(60):
        passage = r.choice(items)[1] or ""
        w = passage.split(" ")
        lo = r.randint(0, max(0, len(w) - 10))
        part = r.choice([" ", "\n", "-", ", "]).join(w[lo : lo + r.randint(8, 20)])
        docs.append((i, text(r.randint(0, 20)) + r.choice([" ", "", "\n"]) + r.choice([part, part.upper(), part.replace("42", "43")]) + r.choice([" ", "x"]) + text(r.randint(0, 20))))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = cases(seed)
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("literals", [0, 13])
def test_templates_lose_no_copy(spark, literals):
    """Whatever number of literal words a template needs, and joined by a shuffle instead of a broadcast."""
    docs, items = cases(3)
    assert found(spark, docs, items, literals=literals, broadcast_bytes=0) == brute(docs, items)


def test_full_bitmap(spark, monkeypatch):
    """A bitmap that lets nearly everything pass changes nothing."""
    monkeypatch.setattr(leak, "MIN_BITS", 15)
    monkeypatch.setattr(leak, "MAX_BITS", 15)
    r = random.Random(6)
    docs, items = cases(6)
    items += [("n%d" % i, " ".join("w%d" % r.randint(0, 9999) for _ in range(300))) for i in range(300)]
    assert found(spark, docs, items) == brute(docs, items)


def test_long_document(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = "filler words " * 200_000 + passage.upper().replace(" ", "\n") + " more filler" * 10
    assert found(spark, [(1, long), (2, long.replace("SEVEN", "7"))], [("a", passage)]) == {(1, "a")}


def test_hot_passage(spark):
    """A passage that a third of all documents have, in several items."""
    passage = " ".join("w%d" % i for i in range(14))
    docs = [(i, passage if i % 3 == 0 else "other text") for i in range(90)]
    items = [("i%d" % i, passage) for i in range(5)]
    assert found(spark, docs, items) == {(d, i) for d, t in docs if t == passage for i, _ in items}


def test_rows_of_numbers(spark):
    """A row of numbers has no template: it is a copy of the same row, and nothing of any other."""
    row = lambda k: " ".join(str(k + i) for i in range(60))
    docs, items = [(i, row(i * 100)) for i in range(20)], [("i%d" % i, row(i * 100)) for i in range(5)]
    assert found(spark, docs, items) == {(i, "i%d" % i) for i in range(5)}
    assert changed(spark, docs, items) == {}


def test_nothing(spark):
    assert found(spark, [], [("a", "x " * 20)]) == set()
    assert found(spark, [(1, "x " * 20)], []) == set()
    assert changed(spark, [], [("a", "x " * 20)]) == changed(spark, [(1, "x 1 " * 20)], []) == {}


def changed(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "k", "w") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "i") for x in items], ITEMS)
    rows = leak.same_questions(d, i, **more).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): (r.n_changed, r.n_same) for r in rows}


def test_other_parameters(spark):
    """Consistent other values are the same question, whatever the names; inconsistent ones and rows of numbers aren't."""
    item = "If Alice has 12 apples and Bob has 7 apples then Alice gives 12 of them to Bob each 3 days"
    docs = {
        1: item,
        2: "If Priya has 40 apples and Wei has 9 apples then Priya gives 40 of them to Wei each 5 weeks",
        3: "If Carol has 40 apples and Dave has 9 apples then Dave gives 41 of them to Eve each 5 weeks",
        4: "If Carol owns 40 pears",
        5: " ".join(map(str, range(40))),
        6: None,
        7: "",
        8: "and so: " + item.replace("12", "1,250").replace("7", "1.5") + ".",
        9: item.replace("12", "twenty").replace("days", "fortnights"),
        10: item.upper(),
    }
    got = changed(spark, list(docs.items()), [("a", item), ("again", item), ("none", None), ("numbers", " ".join(map(str, range(50, 90))))])
    every = len(item.split()) - 13 + 1
    assert {k for k, i in got if i == "a"} == {2, 8, 9} and not any(i == "numbers" for _, i in got)
    assert got[2, "a"] == got[8, "a"] == got[2, "again"] == (every, 0)


def test_consistency_over_the_whole_alignment(spark):
    """A value that is renamed in two ways far apart isn't renamed consistently."""
    part = "the miller weighs %s sacks of grain beside the old river gate and waits for the ferry to come back again before dusk falls "
    item = part % "12" + "and later " + part % "12"
    docs = [(1, part % "30" + "and later " + part % "30"), (2, part % "30" + "and later " + part % "99"), (3, part % "30")]
    got = changed(spark, docs, [("a", item)])
    assert set(got) >= {(1, "a"), (3, "a")} and (2, "a") not in {k for k, v in got.items() if v[0] > len(part.split())}
    two = "the miller weighs %s sacks and the baker takes %s sacks of grain beside the old river gate before dusk falls"
    assert changed(spark, [(1, two % (5, 5)), (2, two % (5, 6))], [("a", two % (3, 4))]).keys() == {(2, "a")}
    assert changed(spark, [(1, two % (5, 5)), (2, two % (5, 6))], [("a", two % (3, 3))]).keys() == {(1, "a")}


def test_kinds_of_slots():
    kind = lambda w: leak.slot_kind(w, frozenset([b"alice"]), frozenset([b"km"]))
    assert [kind(w) for w in (b"12", b"1,200", b"1.5", b"seven", b"km", b"alice", b"12km", b"1.5kg", b"tree", b"x1", b"12abcdefg")] == [1, 1, 1, 1, 3, 4, 2, 2, 0, 0, 0]
    assert leak.VALUE_WORD.findall(b"1,200.5kg 12,34 1.5. v1.5 1,200,30 3.14,") == [b"1,200.5kg", b"12", b"34", b"1.5", b"v1", b"5", b"1", b"200", b"30", b"3.14"]


def brute_changed(docs, items, window=13, literals=leak.LITERALS):
    """(doc, item) to (changed, same) in plain Python, in texts without forms: every word is lower-case and unlisted."""
    units, names = frozenset(u.encode() for u in leak.UNITS), frozenset([b"ann", b"bea", b"cy"])
    kind = lambda w: leak.slot_kind(w.encode(), names, units)
    out = {}
    for d, t in docs:
        a = words(t)
        for i, p in items:
            b, n = words(p), [0, 0]
            for shift in range(-len(b), len(a)):
                at = [x for x in range(max(0, shift), min(len(a), shift + len(b)) - window + 1)]
                fits = lambda x: all(kind(a[x + k]) == kind(b[x - shift + k]) and (kind(a[x + k]) or a[x + k] == b[x - shift + k]) for k in range(window))
                rich = lambda x: sum(kind(a[x + k]) == 0 for k in range(window)) >= literals
                same = lambda x: a[x : x + window] == b[x - shift : x - shift + window]
                at = [x for x in at if same(x) or (rich(x) and fits(x))]
                pairs = {(kind(a[y]), a[y], b[y - shift]) for x in at for y in range(x, x + window) if kind(a[y])}
                if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
                    for x in at:
                        n[same(x)] += 1
            if n[0]:
                out[d, i] = tuple(n)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_other_parameters_against_brute_force(spark, seed):
    """Lower-case texts with given names, in which both readings but for units by place are the same."""
    r = random.Random(seed)
    sentence = "if ann has 12 km and bea has 7 km then ann gives 12 km of them to bea each 3 days and 5km more".split(" ")
    vary = lambda: " ".join(r.choice(["ann", "bea", "cy"]) if w in ("ann", "bea") and r.random() < 0.2 else str(r.randint(1, 9)) if w.isdigit() and r.random() < 0.3 else w for w in sentence)
    items = [("i%d" % i, vary()) for i in range(4)]
    docs = [(i, " ".join(["x"] * r.randint(0, 3)) + " " + vary() + r.choice(["", " tail"])) for i in range(40)]
    got = changed(spark, docs, items, names=["ann", "bea", "cy"])
    wanted = brute_changed(docs, items)
    assert wanted and got == wanted


PLOTS = [
    "{A} bought {x} {u} of rope at the harbour and sold {y} {u} of it to {B}, who later asked {A} for another {x} {u} because the boat was longer than expected",
    "On Monday {A} walks {x} {u} along the canal, rests, and walks {y} {u} more, while {B} follows at half the speed until {A} has covered the first {x} {u}",
    "A tank in the yard holds {x} {u} of oil; {A} drains {y} {u} every morning and {B} refills what {A} has drained, so how long does the oil last",
    "{B} ordered {x} crates for the fair, but {A} could only carry {y} crates a day, so {B} paid {z} coins to anyone who helped {A} with the rest",
    "The teacher gave {A} {x} pencils and {B} {y} pencils, then asked how many pencils {A} would have left after giving {z} of them to {B}",
]


def planted(seed):
    """Items, documents with an item's question in other values, and documents that only look like it."""
    r = random.Random(seed)
    known, other = ["Alice", "Bob", "Carol", "David", "Emma"], ["Priya", "Wei", "Oluwaseun", "Siobhan", "Nguyen", "Rosetta", "Zbigniew", "Aiko"]
    number = lambda: r.choice([str(r.randint(2, 900)), "%d,%03d" % (r.randint(1, 90), r.randint(0, 999)), "%d.%d" % (r.randint(1, 90), r.randint(1, 9)), r.choice(leak.NUMBER_WORDS[2:20])])

    def fill(plot, names, units):
        a, b = r.sample(names, 2)
        x, y, z = set(), None, None
        values = []
        while len(values) < 3:
            if (v := number()) not in values:
                values.append(v)
        x, y, z = values
        return plot.format(A=a, B=b, x=x, y=y, z=z, u=r.choice(units))

    items = [("i%d" % i, fill(PLOTS[i % len(PLOTS)], known, ["metres", "miles", "litres"]), PLOTS[i % len(PLOTS)]) for i in range(25)]
    filler = lambda: " ".join(r.choices("rain fell over the quiet valley while seven lamps burned low and nobody spoke of winter".split(), k=r.randint(5, 40)))
    docs, truth = [], set()
    for i in range(120):
        plot = PLOTS[i % len(PLOTS)]
        if i < 80:
            text = fill(plot, other, ["furlongs", "cubits", "bushels", "miles"])
            truth |= {(i, name) for name, _, p in items if p == plot}
        elif i < 100:  # the names change sides half way
            half = len(plot) // 2
            text = plot[:half].replace("{A}", "Wei").replace("{B}", "Aiko") + plot[half:].replace("{A}", "Priya").replace("{B}", "Wei")
            text = text.format(x="31", y="47", z="5", u="cubits")
        else:
            w = fill(plot, other, ["cubits"]).split(" ")
            text = " ".join(x for k, x in enumerate(w) if k % 9)
        docs.append((i, f"{filler()}. {text}. {filler()}"))
    return docs, [(n, t) for n, t, _ in items], truth


def test_recall_and_precision_on_planted_questions(spark):
    """Names, units and forms of numbers that no list has, and texts that look alike but aren't the same question."""
    docs, items, truth = planted(8)
    got = set(changed(spark, docs, items))
    recall, precision = len(got & truth) / len(truth), len(got & truth) / len(got)
    print(f"recall {recall:.3f}, precision {precision:.3f}, {len(truth)} pairs")
    assert recall >= 0.9 and precision >= 0.9


def test_batches_by_bytes():
    import pyarrow as pa

    from ledgerfold.llm.batches import cut

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([b"x" * (1 << 20) if i % 5 == 0 else b"y" for i in range(50)])], names=["i", "t"])
    pieces = list(cut([batch, batch.slice(0, 0)], 20, 3 << 20))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(50))
    assert max(p.num_rows for p in pieces) <= 20 and max(p.nbytes for p in pieces) <= 3.1 * (1 << 20) and pieces[-1].num_rows == 0
