"""Folds of a log into state: the latest value of each key, merged rows, large objects, events.

All folds are order-free: the last change by its order key counts, wherever and however often it arrived. Order keys must be
unique within a key; of exact repeats one counts. Null keys form a group like any other, except in folds of
log entries, where an entry without a key changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import skew, txn


def latest(rows: DataFrame, keys: list[str], order: list[str], carry: list[str], deleted: Column | None = None) -> DataFrame:
    """(keys, carry): the last row of each key by order; keys whose last row is deleted are left out."""
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(gone.alias("_gone"), *carry), F.struct(*order)).alias("_b"))
    return best.where("NOT _b._gone").select(*keys, *[F.col(f"_b.{c}").alias(c) for c in carry])


def versions(rows: DataFrame, keys: list[str], order: str, deleted: Column) -> DataFrame:
    """(keys, n_versions, n_tombstones, last_order)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_versions"), F.count_if(deleted).alias("n_tombstones"), F.max(order).alias("last_order")
    )


def fold_cells(cells: DataFrame, bars: DataFrame, keys: list[str], part: str, order: list[str], removed: Column, carry: list[str]) -> DataFrame:
    """(keys, part, order, carry): the live cells of rows.

    cells: changes of single cells, removed telling a delete from a write. bars: (keys, order) of whole-row deletes, each of
    which ends everything before it. Both sides are aggregated before they meet, so a row with many changes is no
    hot spot, and no window holds a whole row.
    """
    best = cells.groupBy(*keys, part).agg(F.max_by(F.struct(removed.alias("_gone"), *order, *carry), F.struct(*order)).alias("_b"))
    last = bars.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_bar")).select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_bar")
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    at = F.struct(*[F.col(f"_b.{c}") for c in order])
    joined = best.join(last, same, "left").where((F.col("_bar").isNull() | (at > F.col("_bar"))) & ~F.coalesce(F.col("_b._gone"), F.lit(False)))
    return joined.select(*keys, part, *[F.col(f"_b.{c}").alias(c) for c in [*order, *carry]])


def fold(changes: DataFrame) -> DataFrame:
    """(ns_name, entry_type, entry_key, part, value, ORDER): what txn.units() leave alive."""
    keys = ["ns_name", "entry_type", "entry_key"]
    bars = txn.barriers(changes).select(*keys, "bar.*")
    return fold_cells(changes.where("kind <> 'bar'"), bars, keys, "part", txn.ORDER, F.col("kind") == "del", ["value"]).select(*keys, "part", "value", *txn.ORDER)


def state(log: DataFrame) -> DataFrame:
    """The live values that a log leaves."""
    return fold(txn.units(txn.effective(log)))


def kv(values: DataFrame) -> DataFrame:
    return values.where(F.col("entry_type") == txn.KV).select("ns_name", "entry_key", "value", *txn.ORDER)


def row_cells(values: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Live cells, one per row of the result; columns keeps only those named."""
    cells = values.where(F.col("entry_type") == txn.ROW)
    if columns is not None:
        cells = cells.where(F.col("part").isin(columns))
    return cells.select("ns_name", "entry_key", F.col("part").alias("cell_name"), "value", *txn.ORDER)


def rows(values: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ns_name, entry_key, cells): each row that has a live cell, its cells as a map. For rows of bounded width."""
    cells = row_cells(values, columns)
    return cells.groupBy("ns_name", "entry_key").agg(F.map_from_entries(F.collect_list(F.struct("cell_name", "value"))).alias("cells"))


def chunks(values: DataFrame) -> DataFrame:
    """The chunks of live large objects, (ns_name, entry_key, chunk_no, value), numbered from 0. Objects stay in pieces
    and are numbered in stretches of the log, so the size of one is no limit."""
    found = values.where(F.col("entry_type") == txn.CHUNKED).select("ns_name", "entry_key", "value", "lsn", "entry_no")
    numbered = skew.running(found, ["ns_name", "entry_key"], F.floor(F.col("lsn") / 4096), ["lsn", "entry_no"], F.lit(1), "chunk_no")
    return numbered.select("ns_name", "entry_key", "chunk_no", "value")


def objects(values: DataFrame) -> DataFrame:
    """(ns_name, entry_key, n_chunks, data): large objects in one piece, for objects that fit a row; chunks() is for any size."""
    found = values.where(F.col("entry_type") == txn.CHUNKED)
    parts = found.groupBy("ns_name", "entry_key").agg(F.array_sort(F.collect_list(F.struct(*txn.ORDER, "value"))).alias("c"))
    # joined as digits at once; one concatenation after the other would copy the object for each chunk
    data = F.unhex(F.array_join(F.transform("c", lambda x: F.coalesce(F.hex(x["value"]), F.lit(""))), ""))
    return parts.select("ns_name", "entry_key", F.size("c").alias("n_chunks"), data.alias("data"))


def object_checks(log: DataFrame) -> DataFrame:
    """(ns_name, entry_key, n_chunks, n_expected, is_complete): each live large object, whether all chunks are there that its
    transaction prepared, and its transaction's chain of records has no hole."""
    done = txn.commits(log)
    sent = txn.visible(txn.prepared(txn.entries(log)).where(F.col("entry_type") == txn.CHUNKED), done).select("ns_name", "txn_id", "commit_lsn", "lsn", "entry_no").distinct()
    of_txn = sent.groupBy("ns_name", "txn_id", "commit_lsn").agg(F.count("*").alias("n_expected")).join(txn.chains(log).select("ns_name", "txn_id", "is_complete"), ["ns_name", "txn_id"])
    live = state(log).where(F.col("entry_type") == txn.CHUNKED).groupBy("ns_name", "entry_key", "commit_lsn").agg(F.count("*").alias("n_chunks"))
    both = live.join(of_txn, ["ns_name", "commit_lsn"])
    return both.select("ns_name", "entry_key", "n_chunks", "n_expected", (F.col("is_complete") & (F.col("n_chunks") == F.col("n_expected"))).alias("is_complete"))


def events(log: DataFrame) -> DataFrame:
    """Entries of type Event, which change no state; repeats of a record count once."""
    found = txn.entries(log.where(F.col("entry_type") == txn.EVENT))
    return found.dropDuplicates(["ns_name", "lsn", "entry_no"]).select("ns_name", "lsn", "entry_no", "entry_key", "entry_value")
