"""One copy of each message, against plain Python, over runs."""

import random
import zlib

import pytest

from ledgerfold.operators.dedup import DedupStore
from ledgerfold.session import work_folder

SCHEMA = "batch_id bigint, consumer_id string, ns_name string, records array<struct<lsn:bigint,record:binary,crc32_checksum:bigint>>, code string, bits string"


def brute(batches):
    copies = {}
    for batch, consumer, ns, records, *_ in batches:
        for i, (lsn, record, crc) in enumerate(records or []):
            if lsn is not None:
                bad = crc is not None and (record is None or zlib.crc32(record) != crc)
                copies.setdefault((consumer, ns, lsn), []).append((bad, batch, i))
    return {c[1:] for cs in copies.values() for c in sorted(cs)[1:]}


def random_batches(seed, n=40):
    r = random.Random(seed)
    out = []
    for batch in range(n):
        records = []
        for _ in range(r.randint(0, 6)):
            lsn = r.choice([None, -5, 0, 1, 2, 3, 32767, 32768, 40000, 10**12])
            record = r.choice([None, b"", b"r%d" % (lsn or 0)])
            right = None if record is None else zlib.crc32(record)
            records.append((lsn, record, r.choice([None, right, right, 7])))
        out.append((batch, r.choice(["hub", "hub", None]), r.choice(["main", None, ""]), r.choice([records] * 5 + [None]), "x", "y"))
    return out


@pytest.mark.parametrize("seed,cuts", [(1, [40]), (2, [15, 40]), (3, [5, 6, 30, 40])])
def test_against_brute_force(spark, seed, cuts):
    batches = random_batches(seed)
    store = DedupStore(spark, work_folder(spark, "t").path, broadcast_bytes=0 if seed == 2 else 1 << 20)
    shuffled = random.Random(seed).sample(batches, len(batches))
    low = 0
    for cut in cuts:
        store.ingest(spark.createDataFrame([b for b in shuffled if low <= b[0] < cut], SCHEMA))
        low = cut
        if seed == 3 and cut == 6:
            store.compact()
    found = [tuple(x) for x in store.dropped(spark.createDataFrame(batches, SCHEMA)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(batches)


def test_hot_message_and_nothing(spark):
    """One message many times, in one batch and over many; no batches at all."""
    good = (1, b"r", zlib.crc32(b"r"))
    batches = [(0, "c", "n", [(1, b"bad", 5)] * 50, "", ""), (1, "c", "n", [good] * 200, "", "")] + [(i, "c", "n", [good], "", "") for i in range(2, 50)]
    store = DedupStore(spark, work_folder(spark, "t").path)
    store.ingest(spark.createDataFrame([], SCHEMA))
    store.ingest(spark.createDataFrame(batches[:1], SCHEMA))
    assert store.kept().count() == 1  # only damaged copies so far: the first is kept for now
    store.ingest(spark.createDataFrame(batches[1:], SCHEMA))
    assert [(x.batch_id, x.rec_pos) for x in store.kept().collect()] == [(1, 0)]
    assert {tuple(x) for x in store.dropped(spark.createDataFrame(batches, SCHEMA)).collect()} == brute(batches)


@pytest.mark.parametrize("seed,compact", [(11, False), (12, True)])
def test_late_batches(spark, monkeypatch, seed, compact):
    """Runs that take batches in any order give what one run gives, with arrays of places and with bitmaps."""
    from ledgerfold.operators import dedup

    monkeypatch.setattr(dedup, "SPARSE", 2 if compact else 256)
    batches = random_batches(seed)
    parts = [batches[20:30], batches[:10], batches[30:], batches[10:20]]
    store = DedupStore(spark, work_folder(spark, "t").path, buckets=3)
    for i, part in enumerate(parts):
        store.ingest(spark.createDataFrame(part, SCHEMA))
        if compact and i > 0:
            store.compact()
            store.vacuum()
    found = [tuple(x) for x in store.dropped(spark.createDataFrame(batches, SCHEMA)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(batches)


def test_codes_are_dense(spark):
    """Codes of many consumers in many files, over runs: each number once, from 0, without a gap."""
    store = DedupStore(spark, work_folder(spark, "t").path)
    batch = lambda i, c: (i, "c%d" % c, "n", [(1, b"r", zlib.crc32(b"r"))], "", "")
    store.ingest(spark.createDataFrame([batch(c, c) for c in range(40)], SCHEMA).repartition(9))
    store.ingest(spark.createDataFrame([batch(100 + c, c) for c in range(30, 70)], SCHEMA).repartition(5))
    codes = sorted(r.code for r in store.read_part("dictionary", store.manifest()["dictionary"]).collect())
    assert codes == list(range(70)) and store.manifest()["codes"] == 70
    assert store.kept().count() == 70


def test_only_touched_shards_are_read(spark):
    store = DedupStore(spark, work_folder(spark, "t").path, buckets=64)
    good = lambda n: (n, b"r", zlib.crc32(b"r"))
    store.ingest(spark.createDataFrame([(1, "c", "n", [good(n << 15) for n in range(200)], "", "")], SCHEMA))
    now = store.manifest()
    held = store.read_part("seen", now["seen"])
    assert len(held.inputFiles()) > 30
    assert len(held.where("bucket IN (3)").select("code").distinct().collect()) <= 1
    from pyspark.sql import functions as F

    read = store.read_part("seen", now["seen"], [3]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in read} <= {"3"}


def test_failed_run_is_done_again(spark):
    batches = random_batches(7)
    store = DedupStore(spark, work_folder(spark, "t").path)
    commit, store.folder.commit_json = store.folder.commit_json, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.ingest(spark.createDataFrame(batches, SCHEMA))
    store.folder.commit_json = commit
    assert store.kept().count() == 0
    store.ingest(spark.createDataFrame(batches, SCHEMA))
    assert {tuple(x) for x in store.dropped(spark.createDataFrame(batches, SCHEMA)).collect()} == brute(batches)
