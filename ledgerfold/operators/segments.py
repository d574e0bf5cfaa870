"""Segments of the log: statistics, retention, bounds, gaps, positions, and ranges to copy or cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEALED = 2


def is_sealed(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(SEALED).cast("bigint")) != 0


def distinct_records(log: DataFrame, *columns: str) -> DataFrame:
    """One row for each (ns_name, lsn), with the given columns; a repeated lsn is the same record."""
    values = [F.any_value(c).alias(c) for c in columns]
    keyed = log.groupBy("ns_name", "lsn")
    return keyed.agg(*values) if values else log.select("ns_name", "lsn").distinct()


def segment_stats(log: DataFrame) -> DataFrame:
    """(ns_name, segment_id, n_records, first_lsn, last_lsn, last_offset) of each segment that has records."""
    found = distinct_records(log, "segment_id", "seg_offset")
    return found.groupBy("ns_name", "segment_id").agg(
        F.count("*").alias("n_records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.max("seg_offset").alias("last_offset")
    )


def current_headers(headers: DataFrame) -> DataFrame:
    """The newest header of each segment: by last_modified_at, then entry_count, then write_offset, nulls lowest."""
    rest = [c for c in headers.columns if c not in ("ns_name", "segment_id")]
    best = headers.groupBy("ns_name", "segment_id").agg(
        F.max_by(F.struct(*rest), F.struct("last_modified_at", "entry_count", "write_offset")).alias("h")
    )
    return best.select("ns_name", "segment_id", "h.*")


def totals(headers: DataFrame) -> DataFrame:
    """Per namespace: segments, sealed and active ones, entries, bytes, and the first index that a non-empty segment has."""
    return current_headers(headers).groupBy("ns_name").agg(
        F.count("*").alias("n_segments"),
        F.count_if(is_sealed(F.col("flags"))).alias("n_sealed"),
        F.count_if(~is_sealed(F.col("flags"))).alias("n_active"),
        F.sum("entry_count").alias("n_entries"),
        F.sum("write_offset").alias("n_bytes"),
        F.min(F.when(F.col("first_log_index") > 0, F.col("first_log_index"))).alias("first_index"),
        F.max(F.when(F.col("first_log_index") > 0, F.col("first_log_index") + F.col("entry_count") - 1)).alias("last_index"),
    )


def retention(headers: DataFrame, keep: int, checkpoints: DataFrame | None = None, least: int = 1, cutoff: Column | None = None) -> DataFrame:
    """(ns_name, segment_id): sealed segments to delete so that each namespace keeps at most keep and at least least.

    The oldest go first. With cutoff, a namespace of at most keep but more than least segments loses as many of them as are
    sealed and were last modified at cutoff or before; least doesn't limit their number, as in the reference. With
    checkpoints (ns_name, checkpoint_segment) only segments before the checkpoint's go.
    """
    h = current_headers(headers)
    old = F.lit(False) if cutoff is None else F.coalesce(F.col("last_modified_at") <= cutoff, F.lit(False))
    h = h.select("ns_name", "segment_id", F.coalesce(is_sealed(F.col("flags")), F.lit(False)).alias("sealed"), old.alias("old"))
    w = W.partitionBy("ns_name")
    ranked = h.withColumn("n", F.count("*").over(w)).withColumn("n_old", F.count_if(F.col("sealed") & F.col("old")).over(w))
    ranked = ranked.withColumn("rank", F.count_if("sealed").over(w.orderBy("segment_id")))
    surplus = F.when(F.col("n") > keep, F.least(F.col("n") - keep, F.col("n") - least)).when(F.col("n") > least, F.col("n_old")).otherwise(0)
    out = ranked.where(F.col("sealed") & (F.col("rank") <= surplus)).select("ns_name", "segment_id")
    if checkpoints is not None:
        out = out.join(checkpoints, "ns_name").where(F.col("segment_id") < F.col("checkpoint_segment")).select("ns_name", "segment_id")
    return out


def backup_after(headers: DataFrame, after: int) -> DataFrame:
    """Sealed segments with a greater id, as a backup copies them."""
    return current_headers(headers).where(is_sealed(F.col("flags")) & (F.col("segment_id") > after))


def last_sealed(headers: DataFrame) -> DataFrame:
    found = current_headers(headers).where(is_sealed(F.col("flags")))
    return found.groupBy("ns_name").agg(F.max("segment_id").alias("segment_id"))


def bounds(log: DataFrame) -> DataFrame:
    return log.groupBy("ns_name").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def gaps(records: DataFrame, stream: str = "ns_name", seq: str = "lsn", stretch: int = 1 << 16) -> DataFrame:
    """(stream, from_seq, to_seq): the runs of numbers that are missing between the first and last of each stream.

    Sorted in stretches of numbers, so no stream has to fit one task; the ends of neighbouring stretches, of which there is
    one row each, are compared in a second step. Repeats and disorder don't matter, null numbers are left out.
    """
    s, n = F.col(stream), F.col(seq)
    own = records.where(n.isNotNull()).select(s, n, F.floor(n / stretch).alias("_s")).distinct()
    w = W.partitionBy(stream, "_s").orderBy(seq)
    inner = own.withColumn("_prev", F.lag(seq).over(w)).where(n > F.col("_prev") + 1).select(s, (F.col("_prev") + 1).alias("from_seq"), (n - 1).alias("to_seq"))
    ends = own.groupBy(stream, "_s").agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    before = F.lag("_hi").over(W.partitionBy(stream).orderBy("_s"))
    outer = ends.withColumn("_prev", before).where(F.col("_lo") > F.col("_prev") + 1).select(s, (F.col("_prev") + 1).alias("from_seq"), (F.col("_lo") - 1).alias("to_seq"))
    return inner.unionByName(outer)


def from_position(log: DataFrame, segment: int, offset: int, strict: bool = False) -> DataFrame:
    """Records at or after a position, or after it; positions compare by segment, then offset."""
    seg, off = F.col("segment_id"), F.col("seg_offset")
    return log.where((seg > segment) | ((seg == segment) & ((off > offset) if strict else (off >= offset))))


def from_lsn(log: DataFrame, lsn: int) -> DataFrame:
    """Records from an lsn on; 0 is the beginning."""
    return log if lsn == 0 else log.where(F.col("lsn") >= lsn)


def positions(log: DataFrame) -> DataFrame:
    """The index (ns_name, lsn, segment_id, seg_offset); of several places of a record the last."""
    return log.groupBy("ns_name", "lsn").agg(F.max(F.struct("segment_id", "seg_offset")).alias("p")).select("ns_name", "lsn", "p.*")


def truncate(log: DataFrame, lsn: int) -> DataFrame:
    """The log without what is after lsn; 0 empties it."""
    return log.where(F.col("lsn") <= lsn)


def committed(log: DataFrame, segment: int, offset: int) -> DataFrame:
    """Only records up to the commit boundary, a position."""
    seg, off = F.col("segment_id"), F.col("seg_offset")
    return log.where((seg < segment) | ((seg == segment) & (off <= offset)))


def at_position(log: DataFrame, segment: int, offset: int) -> DataFrame:
    """The records at one position."""
    return log.where((F.col("segment_id") == segment) & (F.col("seg_offset") == offset))


def availability(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """wanted (ns_name, lsn) with status: ok, truncated for what is before the log's first record, or not_yet for what is
    after its last or in a log without records."""
    held = bounds(log).select(F.col("ns_name").alias("_ns"), "first_lsn", "last_lsn")
    status = F.when(F.col("first_lsn").isNull() | (F.col("lsn") > F.col("last_lsn")), "not_yet").when(F.col("lsn") < F.col("first_lsn"), "truncated").otherwise("ok")
    return wanted.join(held, F.col("ns_name").eqNullSafe(F.col("_ns")), "left").select(*wanted.columns, status.alias("status"))


def stored(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log after a batch from a new leader: of each namespace the suffix from the batch's first lsn on is replaced."""
    first = batch.groupBy("ns_name").agg(F.min("lsn").alias("_first")).withColumnRenamed("ns_name", "_ns")
    kept = log.join(first, F.col("ns_name").eqNullSafe(F.col("_ns")), "left").where(F.col("_first").isNull() | (F.col("lsn") < F.col("_first")))
    return kept.select(*log.columns).unionByName(batch.select(*log.columns))


def without_range(log: DataFrame, first: int, last: int, safe: int | None = None) -> DataFrame:
    """The log without first to last, both inclusive; safe is an lsn after which nothing may be deleted."""
    end = last if safe is None else min(last, safe)
    return log.where(~F.col("lsn").between(first, end))
