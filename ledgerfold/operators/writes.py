"""Writing to a log: builders of records for every mutation, and transactions.

A writer numbers its records from the log's end and appends them as a batch. Nothing is applied here: state is what the
folds make of the log. Of two writers to one namespace at once one must lose; that is for the caller to rule out, as
the log has a single writer.
"""

from __future__ import annotations

import time
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.log import LOG
from . import txn
from .parts import dense

CHUNK = 1 << 20


class Transaction:
    """Prepared entries that take effect together, at commit. All are inserts or all deletes, of one entry type."""

    def __init__(self, writer: LogWriter, operation: str, entry_type: str):
        if operation not in (txn.INSERT, txn.DELETE, txn.DELETE_ROW):
            raise ValueError(f"a transaction can't be of {operation}")
        if operation == txn.DELETE and entry_type == txn.CHUNKED:
            raise ValueError("large objects can't be deleted in a transaction")
        self.writer, self.operation, self.entry_type = writer, operation, entry_type
        self.id, self.key, self.crc, self.state = uuid.uuid4().bytes + b"\0" * 4, None, 0, "open"
        self._add(txn.BEGIN, "NoOperation", [])

    def _add(self, state: str, operation: str, entries: list, crc: int = 0) -> None:
        self.writer._record(operation, state, self.entry_type, entries, self.id, crc)

    def _must_be_open(self) -> None:
        if self.state != "open":
            raise ValueError(f"the transaction is {self.state}")

    def put(self, key: bytes, value: bytes | None) -> None:
        """A key and value, or the next chunk of a large object, of which a transaction writes one."""
        self._must_be_open()
        if self.entry_type == txn.ROW:
            raise ValueError("a row transaction takes cells")
        if self.entry_type == txn.CHUNKED and self.key not in (None, key):
            raise ValueError("a transaction writes one large object")
        self.key = key
        self.crc = zlib.crc32(value or b"", self.crc)
        self._add(txn.PREPARE, self.operation, [(key, value, None)], zlib.crc32(value or b""))

    def put_cells(self, key: bytes, cells: dict[str, bytes | None]) -> None:
        self._must_be_open()
        if self.entry_type != txn.ROW:
            raise ValueError("only a row transaction takes cells")
        if not cells:
            raise ValueError("no cells")
        self._add(txn.PREPARE, self.operation, [(key, None, cells)])

    def commit(self) -> int:
        """End the transaction; returns the checksum of what it wrote."""
        self._must_be_open()
        self.state = "committed"
        self._add(txn.COMMIT, self.operation, [(self.key if self.entry_type == txn.CHUNKED else None, None, None)], self.crc)
        return self.crc

    def abort(self) -> None:
        """Write nothing more: what has no commit is never seen."""
        self._must_be_open()
        self.state = "aborted"


def records_of(rows: DataFrame, namespace: str | Column, operation: str, entry_type: str, after: int, entry: Column, segment_records: int = 10_000) -> DataFrame:
    """A log record for each row of a table that is read from files, numbered from after + 1 in the order of the files, without
    anything passing through the driver. entry is a struct of entry_key, entry_value and cells."""
    made = dense(rows, "lsn", after + 1).withColumn("_entry", entry)
    place = F.col("lsn") - 1
    return made.select(
        (F.lit(namespace) if isinstance(namespace, str) else namespace).alias("ns_name"), (F.floor(place / segment_records) + 1).alias("segment_id"), (64 + 64 * (place % segment_records)).alias("seg_offset"), "lsn",
        (F.unix_millis(F.current_timestamp())).alias("hlc"), F.lit(0).cast("bigint").alias("crc32_checksum"), F.lit(operation).alias("operation_type"), F.lit(txn.NONE).alias("txn_state"),
        F.lit(entry_type).alias("entry_type"), F.lit(None).cast("binary").alias("txn_id"), F.lit(None).cast("binary").alias("prev_txn_wal_index"), F.array("_entry").alias("entries"),
        F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
    )


class LogWriter:
    """Collects records of one namespace and appends them to a log in Parquet."""

    def __init__(self, spark: SparkSession, path: str, namespace: str, after: int | None = None, segment_records: int = 10_000):
        self.spark, self.path, self.namespace, self.segment_records = spark, path, namespace, segment_records
        self.lsn = self._end() if after is None else after
        self.rows: list[tuple] = []

    def _end(self) -> int:
        """The last lsn of the namespace in the log; 0 if there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.spark.read.schema(LOG).parquet(self.path).where(F.col("ns_name") == self.namespace).agg(F.max("lsn")).first()[0] or 0

    def _record(self, operation: str, state: str, entry_type: str, entries: list, txn_id: bytes | None = None, crc: int = 0) -> None:
        self.lsn += 1
        at, place = divmod(self.lsn - 1, self.segment_records)
        self.rows.append((self.namespace, at + 1, 64 + 64 * place, self.lsn, time.time_ns() // 1_000_000, crc, operation, state, entry_type, txn_id, None, entries, None))

    def _plain(self, operation: str, entry_type: str, entries: list) -> None:
        if not entries:
            raise ValueError("no entries")
        if any(e[0] is None for e in entries):
            raise ValueError("a key is missing")
        self._record(operation, txn.NONE, entry_type, entries)

    def put(self, *pairs: tuple[bytes, bytes | None]) -> None:
        """Pairs of one record; of equal keys the last counts."""
        self._plain(txn.INSERT, txn.KV, [(k, v, None) for k, v in pairs])

    def delete(self, *keys: bytes) -> None:
        self._plain(txn.DELETE, txn.KV, [(k, None, None) for k in keys])

    def put_cells(self, rows: dict[bytes, dict[str, bytes | None]]) -> None:
        self._plain(txn.INSERT, txn.ROW, [(k, None, c) for k, c in rows.items()])

    def delete_cells(self, rows: dict[bytes, list[str]]) -> None:
        self._plain(txn.DELETE, txn.ROW, [(k, None, dict.fromkeys(c)) for k, c in rows.items()])

    def delete_rows(self, *keys: bytes) -> None:
        self._plain(txn.DELETE_ROW, txn.ROW, [(k, None, None) for k in keys])

    def delete_objects(self, *keys: bytes) -> None:
        self._plain(txn.DELETE, txn.CHUNKED, [(k, None, None) for k in keys])

    def put_object(self, key: bytes, data: bytes, chunk: int = CHUNK) -> int:
        """A large object in chunks, as one transaction; returns its checksum."""
        t = self.begin(txn.INSERT, txn.CHUNKED)
        for at in range(0, max(len(data), 1), chunk):
            t.put(key, data[at : at + chunk])
        return t.commit()

    def begin(self, operation: str = txn.INSERT, entry_type: str = txn.KV) -> Transaction:
        return Transaction(self, operation, entry_type)

    def records(self) -> DataFrame:
        """What has been collected and not appended."""
        return self.spark.createDataFrame(self.rows, LOG)

    def append(self) -> int:
        """Append what has been collected, as one job; returns the last lsn."""
        if self.rows:
            self.records().coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []
        return self.lsn
