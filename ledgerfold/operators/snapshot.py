"""Snapshots of the state at an LSN, and recovery from one by replaying only the log after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import state, txn


def upto(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") <= lsn)


def snapshot_changes(log: DataFrame, lsn: int) -> DataFrame:
    """The state at an LSN as changes that can be folded again: for each value its last change, deletes included, and
    for each row or object its last barrier."""
    changes = txn.units(txn.effective(upto(log, lsn)))
    keys = ["ns_name", "entry_type", "entry_key"]
    best = changes.where("kind <> 'bar'").groupBy(*keys, "part").agg(F.max_by(F.struct("value", "kind", *txn.ORDER), txn.order_key()).alias("b"))
    bars = changes.where("kind = 'bar'").groupBy(*keys).agg(F.max(txn.order_key()).alias("b"))
    return best.select(*keys, "part", "b.value", "b.kind", *[f"b.{c}" for c in txn.ORDER]).unionByName(
        bars.select(*keys, F.lit("").alias("part"), F.lit(None).cast("binary").alias("value"), F.lit("bar").alias("kind"), *[f"b.{c}" for c in txn.ORDER])
    )


def tail_changes(log: DataFrame, lsn: int) -> DataFrame:
    """Changes that take effect after an LSN; prepared entries from before it count if their commit comes after."""
    done = txn.commits(log).where(F.col("commit_lsn") > lsn)
    rows = txn.entries(log)
    return txn.units(txn.plain(rows.where(F.col("lsn") > lsn)).unionByName(txn.visible(txn.prepared(rows), done)))


def recover(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The live values of a snapshot with the tail of the log replayed onto it: the same as the fold of the whole log."""
    return state.fold(snapshot.unionByName(tail))
