"""Transactions of the log: which entries count, and in which order.

Prepared entries take effect at their transaction's commit. The effective order is
(commit_lsn, lsn, entry_no); outside a transaction commit_lsn is the record's own lsn. The commit's
operation holds for all entries of the transaction. A transaction without a commit has no effect.
A repeated (ns_name, lsn) is the same record, so every result is the same with or without repeats. A transaction ends at
its first commit: a second one, and what was prepared after the first, has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Names of the log's enums, fixed values.
INSERT, DELETE, DELETE_ROW = "Insert", "Delete", "DeleteRowByKey"
NONE, BEGIN, PREPARE, COMMIT = "None", "Begin", "Prepare", "Commit"
KV, CHUNKED, ROW, EVENT = "KV", "Chunked", "Row", "Event"

ORDER = ["commit_lsn", "lsn", "entry_no"]


def order_key() -> Column:
    return F.struct(*ORDER)


def commits(log: DataFrame) -> DataFrame:
    """(ns_name, txn_id, commit_lsn, commit_op): one row per committed transaction; a transaction ends at its first commit."""
    found = log.where((F.col("txn_state") == COMMIT) & F.col("txn_id").isNotNull())
    return (
        found.groupBy("ns_name", "txn_id")
        .agg(F.min(F.struct("lsn", "operation_type")).alias("c"))
        .select("ns_name", "txn_id", F.col("c.lsn").alias("commit_lsn"), F.col("c.operation_type").alias("commit_op"))
    )


def entries(log: DataFrame, *keep: str) -> DataFrame:
    """One row per element of entries; null and empty lists give none."""
    return log.select(
        "ns_name", "lsn", "operation_type", "txn_state", "entry_type", "txn_id", *keep,
        F.posexplode("entries").alias("entry_no", "e"),
    ).select(
        "ns_name", "lsn", "operation_type", "txn_state", "entry_type", "txn_id", *keep,
        F.col("entry_no").cast("bigint").alias("entry_no"),
        F.col("e.entry_key").alias("entry_key"), F.col("e.entry_value").alias("entry_value"), F.col("e.cells").alias("cells"),
    )


def plain(rows: DataFrame) -> DataFrame:
    """Entries outside a transaction that change state. Chunks are only written in a transaction; an object can be deleted without one."""
    changes = F.col("entry_type").isin(KV, ROW) & F.col("operation_type").isin(INSERT, DELETE, DELETE_ROW)
    return rows.where(
        (F.col("txn_state") == NONE) & (changes | ((F.col("entry_type") == CHUNKED) & (F.col("operation_type") == DELETE)))
    ).withColumn("commit_lsn", F.col("lsn"))


def prepared(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("txn_state") == PREPARE) & F.col("txn_id").isNotNull() & F.col("entry_type").isin(KV, ROW, CHUNKED))


def visible(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """Prepared entries of committed transactions, with commit_lsn and the commit's operation."""
    c = done.select(F.col("ns_name").alias("c_ns"), F.col("txn_id").alias("c_txn"), "commit_lsn", "commit_op")
    return (
        waiting.join(c, F.col("ns_name").eqNullSafe(F.col("c_ns")) & (F.col("txn_id") == F.col("c_txn")) & (F.col("lsn") < F.col("commit_lsn")))
        .drop("c_ns", "c_txn", "operation_type")
        .withColumnRenamed("commit_op", "operation_type")
    )


def invisible(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """Prepared entries of transactions that have no commit: aborted or still open."""
    c = done.select(F.col("ns_name").alias("c_ns"), F.col("txn_id").alias("c_txn"), "commit_lsn")
    return waiting.join(c, F.col("ns_name").eqNullSafe(F.col("c_ns")) & (F.col("txn_id") == F.col("c_txn")) & (F.col("lsn") < F.col("commit_lsn")), "left_anti")


def uncommitted(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """Prepared entries of transactions that no commit has ended."""
    c = done.select(F.col("ns_name").alias("c_ns"), F.col("txn_id").alias("c_txn"))
    return waiting.join(c, F.col("ns_name").eqNullSafe(F.col("c_ns")) & (F.col("txn_id") == F.col("c_txn")), "left_anti")


def effective(log: DataFrame) -> DataFrame:
    """Every entry that takes effect, with ORDER: plain entries and those of committed transactions."""
    rows = entries(log)
    return plain(rows).unionByName(visible(prepared(rows), commits(log)))


def units(rows: DataFrame) -> DataFrame:
    """Effective entries as changes of single values: (ns_name, entry_type, entry_key, part, value, kind, ORDER).

    kind: put, del, or bar for a barrier, which ends everything of the key before it. part names the cell of a
    row, or the chunk of a large object; it is '' otherwise. Each chunk of a large object comes with the barrier
    at its commit, since a commit replaces the whole object; a delete of a large object is a barrier. Entries without a key, and row
    inserts without cells, change nothing.
    """
    is_row, removes = F.col("entry_type") == ROW, F.col("operation_type") == DELETE
    fits = F.when(is_row, F.col("operation_type").isin(INSERT, DELETE, DELETE_ROW)).otherwise(F.col("operation_type").isin(INSERT, DELETE))
    kind = F.when(removes, "del").otherwise("put")
    unit = lambda part, value, kind: F.struct(part.alias("part"), value.alias("value"), kind.alias("kind"))
    cells = F.transform(F.map_entries("cells"), lambda c: unit(c["key"], c["value"], kind))
    is_object = F.col("entry_type") == CHUNKED
    part = F.when(is_object & ~removes, F.concat_ws("/", "lsn", "entry_no")).otherwise("")
    whole = F.array(unit(part, F.col("entry_value"), F.when(is_row | (is_object & removes), "bar").otherwise(kind)))
    # one pass over the entries: what an entry changes is an array, of its cells or of itself
    changes = F.when(is_row & (F.col("operation_type") != DELETE_ROW), cells).otherwise(whole)
    keyed = rows.where(F.col("entry_key").isNotNull() & fits)
    out = keyed.select("ns_name", "entry_type", "entry_key", *ORDER, F.explode(changes).alias("c"))
    return out.select("ns_name", "entry_type", "entry_key", *ORDER, "c.part", "c.value", "c.kind")


def barriers(changes: DataFrame) -> DataFrame:
    """(ns_name, entry_type, entry_key, bar): the last barrier of each key that has one, as ORDER."""
    chunk = F.col("entry_type") == CHUNKED
    at = F.struct(
        F.col("commit_lsn"),
        F.when(chunk, F.lit(-1).cast("bigint")).otherwise(F.col("lsn")).alias("lsn"),
        F.when(chunk, F.lit(-1).cast("bigint")).otherwise(F.col("entry_no")).alias("entry_no"),
    )
    return changes.where((F.col("kind") == "bar") | chunk).groupBy("ns_name", "entry_type", "entry_key").agg(F.max(at).alias("bar"))


def chains(log: DataFrame) -> DataFrame:
    """(ns_name, txn_id, entry_type, n_prepared, n_missing, is_complete): each committed transaction, with how many of its records name a
    record before them that the log doesn't hold, by the position that each has of the one before. A chain goes from the commit
    back to the begin; a record whose position is null, other than the begin, breaks it too. Repeats count once.
    """
    from ..functions import keys

    own = log.where(F.col("txn_id").isNotNull()).groupBy("ns_name", "txn_id", "lsn").agg(*[F.any_value(c).alias(c) for c in ("txn_state", "entry_type", "segment_id", "seg_offset", "prev_txn_wal_index")])
    at = keys.decode_position(F.col("prev_txn_wal_index"))
    named = own.where(F.col("txn_state") != BEGIN).select("ns_name", "txn_id", "txn_state", "entry_type", at["segment_id"].alias("segment_id"), at["seg_offset"].alias("seg_offset"))
    held = own.select(*[F.col(c).alias(f"h_{c}") for c in ("ns_name", "txn_id", "segment_id", "seg_offset")])
    same = F.col("ns_name").eqNullSafe(F.col("h_ns_name")) & (F.col("txn_id") == F.col("h_txn_id")) & (F.col("segment_id") == F.col("h_segment_id")) & (F.col("seg_offset") == F.col("h_seg_offset"))
    found = named.join(held, same, "left").groupBy("ns_name", "txn_id").agg(
        F.max(F.when(F.col("txn_state") == COMMIT, F.col("entry_type"))).alias("entry_type"), F.count_if(F.col("txn_state") == COMMIT).alias("n_commits"),
        F.count_if(F.col("txn_state") == PREPARE).alias("n_prepared"), F.count_if(F.col("h_txn_id").isNull()).alias("n_missing"),
    )
    return found.where("n_commits > 0").drop("n_commits").withColumn("is_complete", F.col("n_missing") == 0)
