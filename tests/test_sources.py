"""Segment files, logs in Parquet, writers, and text of benchmarks."""

import os
import struct

import pytest
from logs import LOG, fold, random_log

from ledgerfold.functions.checksums import crc32c, crc32c_column, crc32c_many
from ledgerfold.operators import state
from ledgerfold.operators.change_feed import live_values
from ledgerfold.operators.writes import LogWriter
from ledgerfold.sources import benchtext, flat, log as log_source, segments


def test_crc32c():
    """The check value of the polynomial, and many at once."""
    assert crc32c(b"123456789") == 0xE3069283
    values = [b"123456789", b"", None, b"a" * 300, b"123456789"]
    assert crc32c_many(values) == [None if v is None else crc32c(v) for v in values]
    assert crc32c_many([]) == []


def test_crc32c_column(spark):
    from ledgerfold.session import ship

    ship(spark)
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "v binary")
    assert [r[0] for r in df.select(crc32c_column(df.v)).collect()] == [0xE3069283, None, 0]


def test_flat_tables():
    data = flat.build([("Q", 7), None, b"name", [[b"x", ("B", 3)], [None, ("B", 4)]], []])
    t = flat.Table(data)
    assert (t.scalar(0, "Q"), t.scalar(1, "I"), t.bytes(2), t.scalar(9, "Q"), t.bytes(9)) == (7, 0, b"name", 0, None)
    assert [(x.bytes(0), x.scalar(1, "B")) for x in t.tables(3)] == [(b"x", 3), (None, 4)]
    assert t.tables(4) == [] and t.tables(9) == []


def test_frames_stop_at_damage():
    whole = segments.write_segment([(5, b"one"), (6, b"two" * 50), (7, b"three")])
    assert [(o % 8, d) for o, d in segments.frames(whole)] == [(0, b"one"), (0, b"two" * 50), (0, b"three")]
    head = segments.header(whole)
    assert head["is_valid"] and (head["first_log_index"], head["entry_count"], head["write_offset"]) == (5, 3, len(whole))
    second = [o for o, _ in segments.frames(whole)][1]
    flipped = bytearray(whole)
    flipped[second + 10] ^= 1
    assert [d for _, d in segments.frames(bytes(flipped))] == [b"one"]
    assert [d for _, d in segments.frames(whole[: second + 20])] == [b"one"]  # torn
    assert [d for _, d in segments.frames(whole + bytes(64))] == [b"one", b"two" * 50, b"three"]  # the file is longer than what was written
    open_one = bytearray(segments.write_segment([(1, b"one"), (2, b"two")], sealed=False))
    at = [o for o, _ in segments.frames(bytes(open_one))][1]
    open_one[at + 9] ^= 1
    assert len(list(segments.frames(bytes(open_one)))) == 2  # checksums count in sealed segments
    assert list(segments.frames(b"")) == [] and list(segments.frames(b"x" * 100)) == []
    assert not segments.header(bytes(64))["is_valid"]


def test_log_to_segment_files_and_back(spark, tmp_path):
    records = [r for r in random_log(4) if r[0] == "n"]
    log = spark.createDataFrame(records, LOG)
    for f in segments.to_segments(log).collect():
        (tmp_path / f.file_name).write_bytes(bytes(f.content))
    (tmp_path / "other.txt").write_text("no segment")
    back = segments.read_log(spark, str(tmp_path), "n")
    places = lambda df: {(r.ns_name, r.entry_type, bytes.fromhex(r.key_hex), r.cell_name): (r.lsn, r.entry_no) for r in live_values(state.state(df)).collect()}
    assert back.count() == len({r[3] for r in records})
    assert places(back) == fold(records)[0]
    heads = segments.read_headers(spark, str(tmp_path)).collect()
    assert all(h.is_valid for h in heads) and sum(h.entry_count for h in heads) == back.count()


def test_record_round_trip():
    r = dict(
        lsn=2**40, hlc=5, crc32_checksum=2**32 - 1, operation_type="Insert", txn_state="Prepare", entry_type="Row", txn_id=b"t" * 20, prev_txn_wal_index=struct.pack("<Iq", 3, 9),
        entries=[(b"\xfe\x00", None, {"é": b"", "b": None}), (b"", None, {})],
    )
    assert segments.record(segments.encode_record(r)) == r
    for kind in ("KV", "Chunked", "Event"):
        plain = r | dict(entry_type=kind, txn_id=None, prev_txn_wal_index=None, entries=[(b"k", b"v", None), (b"", None, None), (None, b"", None)])
        assert segments.record(segments.encode_record(plain)) == plain


def test_writer(spark, tmp_path):
    path = str(tmp_path / "log")
    w = LogWriter(spark, path, "n")
    w.put((b"a", b"1"), (b"b", b"2"), (b"a", b"3"))
    w.delete(b"b", b"never")
    w.put_cells({b"r": {"x": b"1", "y": None}})
    w.delete_cells({b"r": ["y"]})
    older, newer = w.begin(), w.begin()
    older.put(b"k", b"old")
    newer.put(b"k", b"new")
    newer.commit()
    older.commit()
    lost = w.begin()
    lost.put(b"lost", b"v")
    lost.abort()
    assert w.put_object(b"lob", b"0123456789", 4) == __import__("zlib").crc32(b"0123456789")
    assert w.append() == w.lsn and w.append() == w.lsn
    again = LogWriter(spark, path, "n")
    assert again.lsn == w.lsn
    again.delete_rows(b"r")
    again.put_cells({b"r": {"z": b"9"}})
    again.append()
    found = state.state(log_source.read(spark, path))
    assert {(r.entry_type, bytes(r.entry_key), r.part, bytes(r.value)) for r in found.collect() if r.entry_type != "Chunked"} == {
        ("KV", b"a", "", b"3"), ("KV", b"k", "", b"old"), ("Row", b"r", "z", b"9"),
    }
    (lob,) = state.objects(found).collect()
    assert (bytes(lob.data), lob.n_chunks) == (b"0123456789", 3)


def test_writer_refuses(spark, tmp_path):
    w = LogWriter(spark, str(tmp_path / "log"), "n")
    for call in (
        lambda: w.put(), lambda: w.put((None, b"v")), lambda: w.begin("NoOperation"), lambda: w.begin("Delete", "Chunked"), lambda: w.begin().put_cells(b"r", {"a": b""}),
        lambda: w.begin(entry_type="Row").put_cells(b"r", {}), lambda: w.begin(entry_type="Row").put(b"r", b""),
    ):
        with pytest.raises(ValueError):
            call()
    t = w.begin(entry_type="Chunked")
    t.put(b"k", b"1")
    with pytest.raises(ValueError):
        t.put(b"other", b"2")
    t.commit()
    with pytest.raises(ValueError):
        t.put(b"k", b"3")


def test_benchmark_text(spark, tmp_path):
    (tmp_path / "b.csv").write_text('"test","rps","avg_latency_ms","p50_latency_ms"\n"SET","123.5","0.1","0.2"\n"GET","x","0.1","0.2"\n')
    assert [tuple(r) for r in benchtext.load_csv(spark, str(tmp_path / "b.csv")).collect()] == [("SET", 123.5, 0.2)]
    lines = [
        "gc 7 @1.250s 2%: 0.5+1.5+0.25 ms clock, 1+2/3/4+5 ms cpu, 4->5->2 MB, 8 MB goal, 0 MB stacks, 0 MB globals, 8 P",
        "gc 8 @2.250s 2%: 0.25+1.5+0 ms clock, 1+2/3/4+5 ms cpu, 4->5->2 MB, 8 MB goal, 0 MB stacks, 0 MB globals, 8 P",
        "something else",
        "BenchmarkSegments/read-8   	 1000	  1234.5 ns/op	 98.7 MB/s",
        "BenchmarkPlain 5 10 ns/op",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    trace = benchtext.gc_lines(df)
    assert [tuple(r) for r in trace.orderBy("cycle").collect()][0] == (7, 1.25, 2.0, 0.75, 1.5, 4, 2, 8)
    assert benchtext.gc_summary(trace).first().asDict() == pytest.approx({"n": 2, "span_s": 1.0, "mean_ms": 0.5, "p95_ms": 0.725})
    assert [tuple(r) for r in benchtext.bench_lines(df).collect()] == [("Segments/read", 1000, 1234.5, 98.7), ("Plain", 5, 10.0, None)]
    log = spark.createDataFrame([(i, v) for i, v in enumerate(["x 9", "run relayers=3", "lat 5", "lat 6", "run relayers=4", "lat 7"])], "i int, value string")
    found = benchtext.blocks(log, "i", r"relayers=(\d+)", r"^lat (\d+)")
    assert [tuple(r) for r in found.collect()] == [("3", "5"), ("3", "6"), ("4", "7")]
