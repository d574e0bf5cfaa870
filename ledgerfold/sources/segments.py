"""Segment files: frames of records behind a header of 64 bytes.

A frame is CRC-32C (4 bytes, of the length and the data), the length (4), the data, and a trailer of 8 bytes, filled up to a
multiple of 8. A scan stops at the first frame that is absent, torn or, in a sealed segment, damaged, as what follows
can't be trusted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checksums import crc32c, crc32c_many
from ..session import ship
from . import flat

#: The file format, fixed values.
HEADER, FRAME, TRAILER = 64, 8, bytes.fromhex("DEADBEEFFEEDFACE")
MAGIC, VERSION, SEALED = 0x5557414C, 1, 2

#: The enums of records, fixed values.
OPERATIONS = ["NoOperation", "Insert", "Delete", "TxnMarker", "DeleteRowByKey", "RaftInternal"]
STATES = ["None", "Begin", "Prepare", "Commit"]
TYPES = ["KV", "Chunked", "Row", "Event"]

FRAMES = "path string, segment_id bigint, seg_offset bigint, data binary"
HEADERS = "path string, segment_id bigint, magic bigint, fmt_version bigint, created_ns bigint, modified_ns bigint, write_offset bigint, entry_count bigint, flags bigint, first_log_index bigint, crc bigint, is_valid boolean"
RECORD = "lsn bigint, hlc bigint, crc32_checksum bigint, operation_type string, txn_state string, entry_type string, txn_id binary, prev_txn_wal_index binary, entries array<struct<entry_key:binary,entry_value:binary,cells:map<string,binary>>>"
RECORD_COLUMNS = ["lsn", "hlc", "crc32_checksum", "operation_type", "txn_state", "entry_type", "txn_id", "prev_txn_wal_index", "entries"]


def header(data: bytes) -> dict | None:
    """The fields of a segment's header; None if it is too short."""
    if len(data) < HEADER:
        return None
    magic, version, created, modified, offset, count, flags, first = struct.unpack_from("<IIqqqqIQ", data, 0)
    crc = struct.unpack_from("<I", data, 56)[0]
    return dict(magic=magic, fmt_version=version, created_ns=created, modified_ns=modified, write_offset=offset, entry_count=count, flags=flags, first_log_index=first, crc=crc, is_valid=crc == crc32c(data[:56]) and magic == MAGIC)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the frames up to the first that isn't whole."""
    head = header(data)
    if head is None or head["magic"] != MAGIC:
        return
    found, at = [], HEADER
    while at + FRAME <= len(data):
        crc, size = struct.unpack_from("<II", data, at)
        end = at + FRAME + size
        if size == 0 or end + len(TRAILER) > len(data) or data[end : end + len(TRAILER)] != TRAILER:
            break
        found.append((at, crc, data[at + 4 : end]))
        at = (end + len(TRAILER) + 7) // 8 * 8
    sums = crc32c_many([f[2] for f in found]) if head["flags"] & SEALED else [f[1] for f in found]
    for (offset, crc, body), right in zip(found, sums):
        if crc != right:
            return
        yield offset, body[4:]


def write_segment(records: list[tuple[int, bytes]], sealed: bool = True, created_ns: int = 0) -> bytes:
    """A segment's bytes from (lsn, data) of its records."""
    body = b""
    for _, data in records:
        size = struct.pack("<I", len(data))
        frame = struct.pack("<I", crc32c(size + data)) + size + data + TRAILER
        body += frame + bytes(-len(frame) % 8)
    first = records[0][0] if records else 0
    head = struct.pack("<IIqqqqIQ", MAGIC, VERSION, created_ns, created_ns, HEADER + len(body), len(records), SEALED if sealed else 8, first)
    head = head.ljust(56, b"\0")
    return head + struct.pack("<II", crc32c(head), 0) + body


def entry(data: bytes, kind: str) -> tuple[bytes | None, bytes | None, dict | None]:
    t = flat.Table(data)
    if kind == "Row":
        return t.bytes(0), None, {(c.bytes(0) or b"").decode("utf-8", "replace"): c.bytes(1) for c in t.tables(1)}
    if kind == "Event":
        return t.bytes(0), t.bytes(3), None
    return t.bytes(0), t.bytes(1), None


def record(data: bytes) -> dict:
    """The columns of RECORD from a record's bytes."""
    t = flat.Table(data)
    kind = TYPES[t.scalar(5, "B")]
    return dict(
        lsn=t.scalar(0, "Q"), hlc=t.scalar(1, "Q"), crc32_checksum=t.scalar(2, "I"), operation_type=OPERATIONS[t.scalar(3, "B")],
        txn_state=STATES[t.scalar(4, "B")], entry_type=kind, txn_id=t.bytes(6), prev_txn_wal_index=t.bytes(7), entries=[entry(e.bytes(0), kind) for e in t.tables(8)],
    )


def encode_record(r: dict) -> bytes:
    """A record's bytes from the columns of RECORD."""

    def one(e) -> bytes:
        key, value, cells = e
        if r["entry_type"] == "Row":
            return flat.build([key, [[name.encode(), cell] for name, cell in (cells or {}).items()]])
        if r["entry_type"] == "Event":
            return flat.build([key, None, None, value])
        return flat.build([key, value])

    entries = [[one(e)] for e in r["entries"] or []]
    numbers = [("Q", r["lsn"]), ("Q", r["hlc"] or 0), ("I", r["crc32_checksum"] or 0)]
    enums = [("B", OPERATIONS.index(r["operation_type"])), ("B", STATES.index(r["txn_state"])), ("B", TYPES.index(r["entry_type"]))]
    return flat.build([*numbers, *enums, r["txn_id"], r["prev_txn_wal_index"], entries])


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    number = F.regexp_extract(F.col("path"), r"(\d+)\.seg$", 1).cast("bigint")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").option("recursiveFileLookup", "true").load(path).select("path", number.alias("segment_id"), "content")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAMES of all segment files below path, one task per group of files; a file's number is in its name."""
    return frames_of(_files(spark, path))


def frames_of(files: DataFrame) -> DataFrame:
    """FRAMES of files that stand in a table (path, segment_id, content), as to_segments() makes them."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, number, content in zip(*[c.to_pylist() for c in batch.columns]):
                rows = list(frames(content))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["path", "segment_id", "seg_offset", "data"],
                )

    return files.select("path", "segment_id", "content").mapInArrow(run, FRAMES)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS of all segment files; those too short for a header are left out."""
    return headers_of(_files(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """HEADERS of files that stand in a table (path, segment_id, content)."""
    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [dict(path=p, segment_id=s, **h) for p, s, h in zip(pdf["path"], pdf["segment_id"], (header(bytes(c)) for c in pdf["head"])) if h]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in HEADERS.split(", ")])

    return files.select("path", "segment_id", F.substring("content", 1, HEADER).alias("head")).mapInPandas(run, HEADERS)


def read_log(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """The log records of segment files, with the columns that the operators take."""
    return records_of(read_frames(spark, path)).select(F.lit(namespace).alias("ns_name"), "segment_id", "seg_offset", *RECORD_COLUMNS)


def records_of(found: DataFrame) -> DataFrame:
    """(path, segment_id, seg_offset, RECORD) of FRAMES."""
    ship(found.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = batch.column(3).to_pylist()
            rows = [record(d) for d in data]
            cells = pa.map_(pa.string(), pa.binary())
            kind = pa.list_(pa.struct([("entry_key", pa.binary()), ("entry_value", pa.binary()), ("cells", cells)]))
            made = [[dict(entry_key=k, entry_value=v, cells=None if c is None else list(c.items())) for k, v, c in r["entries"]] for r in rows]
            simple = [("lsn", pa.int64()), ("hlc", pa.int64()), ("crc32_checksum", pa.int64()), ("operation_type", pa.string()), ("txn_state", pa.string()), ("entry_type", pa.string()), ("txn_id", pa.binary()), ("prev_txn_wal_index", pa.binary())]
            columns = [pa.array([r[c] for r in rows], t) for c, t in simple]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(made, kind)], names=["path", "segment_id", "seg_offset", *[c for c, _ in simple], "entries"])

    return found.mapInArrow(run, f"path string, segment_id bigint, seg_offset bigint, {RECORD}")


def to_segments(log: DataFrame) -> DataFrame:
    """(ns_name, segment_id, file_name, content): the files of a log's segments, each record once, in the order of lsn.

    A segment is of bounded size by the log's own rotation, so it fits the one task that builds it.
    """
    ship(log.sparkSession)
    names = RECORD_COLUMNS

    def run(group):
        import pyarrow as pa

        rows = {r["lsn"]: r for r in group.to_pylist()}
        made = []
        for lsn in sorted(rows):
            r = rows[lsn]
            r["entries"] = [(e["entry_key"], e["entry_value"], None if e["cells"] is None else dict(e["cells"])) for e in r["entries"] or []]
            made.append((lsn, encode_record(r)))
        first = next(iter(rows.values()))
        return pa.table({"ns_name": [first["ns_name"]], "segment_id": [first["segment_id"]], "file_name": ["%09d.seg" % first["segment_id"]], "content": pa.array([write_segment(made)], pa.binary())})

    return log.select("ns_name", "segment_id", *names).groupBy("ns_name", "segment_id").applyInArrow(run, "ns_name string, segment_id bigint, file_name string, content binary")
