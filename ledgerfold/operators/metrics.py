"""Counts, rates, latencies and lags over logs and operations."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import nulls
from ..session import ship
from . import skew


def op_counts(rows: DataFrame, by: list[str], failed: Column | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_ops"), F.count_if(F.lit(False) if failed is None else failed).alias("n_errors"))


#: Into how many ranges of values a group is cut for exact quantiles.
RANGES = 1024


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], exact: bool = True) -> DataFrame:
    """(by, n, and a column for each quantile), interpolated between neighbours; groups without a value have null ones.

    exact counts rows by value, adds the counts up in order over ranges of values, and picks those at the ranks, so a group is never
    held by one task, whatever its values. exact=False sketches instead, with relative rank error 1/10000.
    """
    if not exact:
        return rows.groupBy(*by).agg(F.count(value).alias("n"), *[F.percentile_approx(value, q, 10_000).alias(name) for name, q in at.items()])
    if not by:
        return quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, at).drop("_all")
    names = nulls.names(by)
    own = rows.select(*nulls.split(rows, by), F.col(value).cast("double").alias("_v"))
    totals = own.groupBy(*names).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counts = own.where("_v IS NOT NULL").groupBy(*names, "_v").agg(F.count("*").alias("_c")).join(totals, names)
    width = F.col("_hi") - F.col("_lo")
    block = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * RANGES)).otherwise(0)
    # the number of rows before a value is the rank of its first row, and that with its own less one that of its last
    ranked = skew.running(counts, names, block, ["_v"], F.col("_c"), "_before", nullable=False)
    picks = []
    for name, q in at.items():
        rank = (F.col("n") - 1) * F.lit(float(q))
        has = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_c"))
        low, high = F.max(F.when(has(F.floor(rank)), F.col("_v"))), F.max(F.when(has(F.ceil(rank)), F.col("_v")))
        picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    found = ranked.groupBy(*names).agg(*picks)
    return totals.join(found, names, "left").select(*nulls.joined(by), "n", *at)


def rates(rows: DataFrame, ts: str, width: str, by: list[str]) -> DataFrame:
    """(by, bucket, n, delta): counts in time buckets and the change from the bucket before that has any."""
    counted = rows.groupBy(*by, F.date_trunc(width, F.col(ts)).alias("bucket")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy("bucket") if by else W.orderBy("bucket")
    return counted.withColumn("delta", F.col("n") - F.lag("n").over(w))


def lag(heads: DataFrame, followers: DataFrame, on: list[str], head: str, at: str, threshold: int) -> DataFrame:
    """followers with their lag behind the head, at least 0, and whether it exceeds the threshold. A follower that has
    applied nothing lags by the whole log."""
    behind = F.greatest(F.col(head) - F.coalesce(F.col(at), F.lit(0)), F.lit(0))
    return followers.join(heads, on).withColumn("lag", behind).withColumn("is_behind", F.col("lag") > threshold)


#: Age buckets and their upper ends in seconds, fixed values; 10m_30m holds what is past 15 minutes.
AGE_BUCKETS = [
    ("0s_1s", 1), ("1s_10s", 10), ("10s_30s", 30), ("30s_1m", 60), ("1m_10m", 600), ("10m_15m", 900), ("10m_30m", 1800),
    ("30m_1h", 3600), ("1h_6h", 21600), ("6h_12h", 43200), ("12h_24h", 86400),
]
OLDEST = "24h_over"


def age_bucket(seconds: Column) -> Column:
    out = None
    for label, top in AGE_BUCKETS:
        out = F.when(seconds < top, label) if out is None else out.when(seconds < top, label)
    return out.otherwise(OLDEST)


def share(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """Percent that one counter has of the sum of several, as in the share of time spent waiting for I/O."""
    whole = sum((F.sum(c) for c in columns), F.lit(0))
    return rows.agg((F.sum(part) / F.nullif(whole, F.lit(0)) * 100).alias("percent"))


#: Rows of one key are put in order in stretches of this many times the gap.
GAPS = 1000


def sessions(rows: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """(by, started_at, ended_at, n): runs of rows without a pause of gap or longer. Rows without ts belong to none.

    Each key is cut into stretches of time; pauses are found inside them and between the last and first row of neighbours, and the
    runs are numbered by running sums over the stretches, so that a key with most rows is no hot spot.
    """
    names = nulls.names(by)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    length = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {gap}")) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    own = rows.where(F.col(ts).isNotNull()).select(*nulls.split(rows, by), F.col(ts).alias("_at"), us.alias("_us"), length.alias("_gap"))
    # rows of one instant belong together and count as one here
    own = own.groupBy(*names, "_at", "_us", "_gap").agg(F.count("*").alias("_rows")).withColumn("_s", F.floor(F.col("_us") / (F.col("_gap") * GAPS)))
    ends = own.groupBy(*names, "_s").agg(F.max("_us").alias("_last")).select(*names, "_s", F.lag("_last").over(W.partitionBy(*names).orderBy("_s")).alias("_end"))
    before = F.coalesce(F.lag("_us").over(W.partitionBy(*names, "_s").orderBy("_us")), F.col("_end"))
    starts = F.when(before.isNull() | (F.col("_us") - before >= F.col("_gap")), 1).otherwise(0)
    marked = own.join(ends, [*names, "_s"]).withColumn("_start", starts)
    numbered = skew.running(marked, names, F.col("_s"), ["_us"], F.col("_start"), "_before", nullable=False).withColumn("_no", F.col("_before") + F.col("_start"))
    found = numbered.groupBy(*names, "_no").agg(F.min("_at").alias("started_at"), F.max("_at").alias("ended_at"), F.sum("_rows").alias("n"))
    return found.select(*nulls.joined(by), "started_at", "ended_at", "n")


def batches(records: DataFrame, stream: str, block: Column, order: list[str], size: Column, limit: int) -> DataFrame:
    """records with batch_no in bins of the running size: the whole part of (bytes before the record / limit). What a bin has
    over limit counts for the next, so bins can be short and numbers can be missing; a sender's batches are flushes(). block
    grows with order and cuts long streams, as skew.running() needs it."""
    return skew.running(records, [stream], block, order, size, "_before").withColumn("batch_no", F.floor(F.col("_before") / limit)).drop("_before")


def flush_map(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int], int]:
    """What a block of records does to an open batch, whatever its size: (least, n, rest, total). An open batch of least[i]
    to least[i + 1] - 1 bytes (at the end limit - 1) leaves n[i] batches full and rest[i] bytes open; one under least[0] isn't
    filled and grows by total. After its first flush a block goes on in the same way whatever was open, so there are
    no more entries than records in one batch."""
    upto, known = [0, *accumulate(sizes)], {}
    total = upto[-1]

    def after(k: int) -> tuple[int, int]:
        path = []
        while k not in known:
            path.append(k)
            if (to := bisect_left(upto, upto[k] + limit)) == len(upto):
                known[k] = (0, total - upto[k])
            else:
                k = to
        n, rest = known[k]
        for k in reversed(path):
            if k not in known:
                n += 1
                known[k] = (n, rest)
        return known[path[0]] if path else (n, rest)

    found = []
    for k in range(1, len(upto)):
        if upto[k] > upto[k - 1]:
            n, rest = after(k)
            found.append((max(0, limit - upto[k]), n + 1, rest))
        if upto[k] >= limit:
            break
    found.sort()
    return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], total


def flushes(records: DataFrame, stream: str, block: Column, order: list[str], size: Column, limit: int) -> DataFrame:
    """records with batch_no as a sender cuts them: in order, sizes are added up until they reach limit; that record ends the
    batch, and the next begins from 0. Only the last batch of a stream can be under limit. A size of null counts as 0.

    block grows with order, which has no nulls, and cuts long streams. flush_map() of each block comes first, then for each stream, from
    block to block, the size of the open batch and the number of full ones, then the blocks' records. So a task holds
    one block, or the maps of one stream.
    """
    ship(records.sparkSession)
    place = [*nulls.names([stream]), skew.BLOCK]
    own = records.select("*", *nulls.split(records, [stream]), block.cast("bigint").alias(skew.BLOCK), F.coalesce(size.cast("bigint"), F.lit(0)).alias("_size"))
    kinds, columns = {f.name: f.dataType.simpleString() for f in own.schema.fields}, records.columns
    names = lambda some: ", ".join(f"`{c}` {kinds[c]}" for c in some)

    def in_order(rows):
        return rows.sort_by([(c, "ascending") for c in order])

    def maps(rows):
        import pyarrow as pa

        least, n, rest, total = flush_map(in_order(rows)["_size"].to_pylist(), limit)
        big = pa.list_(pa.int64())
        first = rows.select(place).slice(0, 1)
        for name, value, kind in (("least", least, big), ("n", n, big), ("rest", rest, big), ("total", total, pa.int64())):
            first = first.append_column(name, pa.array([value], kind))
        return first

    def starts(rows):
        import pyarrow as pa

        rows, done, open_, before = rows.sort_by(skew.BLOCK), 0, 0, []
        for r in rows.select(["least", "n", "rest", "total"]).to_pylist():
            before.append((done, open_))
            i = bisect_right(r["least"], open_) - 1
            done, open_ = (done, open_ + r["total"]) if i < 0 else (done + r["n"][i], r["rest"][i])
        out = rows.select(place).append_column("_done", pa.array([x[0] for x in before], pa.int64()))
        return out.append_column("_open", pa.array([x[1] for x in before], pa.int64()))

    def cut(rows):
        import pyarrow as pa

        rows = in_order(rows)
        done, open_, out = rows["_done"][0].as_py(), rows["_open"][0].as_py(), []
        for n in rows["_size"].to_pylist():
            out.append(done)
            open_ += n
            if open_ >= limit:
                done, open_ = done + 1, 0
        return rows.select(columns).append_column("batch_no", pa.array(out, pa.int64()))

    slim = own.select(*place, *dict.fromkeys(c for c in order if c not in place), "_size")
    found = slim.groupBy(*place).applyInArrow(maps, f"{names(place)}, least array<bigint>, n array<bigint>, rest array<bigint>, total bigint")
    begin = found.groupBy(*place[:-1]).applyInArrow(starts, f"{names(place)}, _done bigint, _open bigint")
    return own.join(begin, place).groupBy(*place).applyInArrow(cut, f"{names(columns)}, batch_no bigint")


#: Percent of log lines kept by level unless others are given, fixed values.
LEVEL_PERCENT = {"debug": 100.0, "info": 25.0, "warn": 100.0, "error": 100.0}


def sampled_levels(rows: DataFrame, level: str, percents: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """A random share of rows by level; unknown levels in percents are an error, rows of unknown levels are left out."""
    given = {k.lower(): v for k, v in (percents or {}).items()}
    if unknown := given.keys() - LEVEL_PERCENT.keys():
        raise ValueError(f"unknown levels: {', '.join(sorted(unknown))}")
    keep = None
    for name, percent in (LEVEL_PERCENT | given).items():
        test = F.lower(level) == name
        keep = F.when(test, percent) if keep is None else keep.when(test, percent)
    return rows.where(F.rand(seed) * 100 < keep)


def slower_than(rows: DataFrame, duration: str, limit: float) -> DataFrame:
    return rows.where(F.col(duration) > limit)
