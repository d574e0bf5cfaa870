"""Runs that process only what is new, and the records that followers of a log still have to process.

A run reads the watermark of the last committed run, fixes its upper limit and writes it down, processes what lies between,
writes its output and the new watermark beside each other, and commits both by one atomic file. A run that fails leaves no commit:
the next one starts from the same watermark and writes folders of its own, so nothing is skipped or repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from ..functions import bitmaps
from ..session import Folder, attempt, staged
from .parts import observed

#: Log sequence numbers are handled in stretches of this many.
STRETCH = 4096


def literal(value, kind: T.DataType) -> Column:
    """A value that was collected, as a literal of its column's type; times as text, so that no time zone of Python's comes in."""
    return F.lit(value if isinstance(value, (int, float, str)) else str(value)).cast(kind)


class IncrementalStore:
    """Outputs and watermarks of committed runs in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def runs(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("commits") if n.endswith(".json"))

    def manifest(self) -> dict:
        """The last run, and the folder of each run by part."""
        done = self.runs()
        return self.folder.read_json(f"commits/{done[-1]}.json") if done else {"run": 0, "marks": None}

    def marks(self) -> DataFrame | None:
        """The watermark of each stream after the last committed run; None before the first."""
        at = self.manifest()["marks"]
        return self.spark.read.parquet(self.folder / f"marks/{at}").drop("_low") if at else None

    def part(self, name: str, *runs: int) -> DataFrame | None:
        """What the committed runs, or those named, gave beside each other under a name; None if nothing."""
        held = self.manifest().get(name, {})
        paths = [self.folder / f"{name}/{f}" for n, f in held.items() if not runs or int(n) in runs]
        return self.spark.read.parquet(*paths) if paths else None

    def output(self, *runs: int) -> DataFrame:
        """What the committed runs gave, or those named."""
        return self.part("out", *runs)

    def commit(self, output: DataFrame | dict[str, DataFrame], marks: DataFrame | str, before: dict | None = None) -> int:
        """Write output, or several by name of which one is out, and watermarks, then commit all at once; returns the run's number.
        What is in the store's folder already is given by its name instead. Of two writers of one run the second to commit gets
        FileExistsError, and what it wrote is never read."""
        before = self.manifest() if before is None else before
        run = before["run"] + 1
        at, now = attempt(run), dict(before)
        parts = (output if isinstance(output, dict) else {"out": output}) | {"marks": marks}
        for name, df in parts.items():
            if not isinstance(df, str):
                df.write.parquet(self.folder / f"{name}/{at}")
            folder = df if isinstance(df, str) else at
            now[name] = folder if name == "marks" else now.get(name, {}) | {str(run): folder}
        self.folder.commit_json(f"commits/{run}.json", now | {"run": run})
        return run

    def run(
        self, source: DataFrame | Callable[[], DataFrame], seq: str, stream: list[str], step: Callable[[DataFrame], DataFrame | dict[str, DataFrame]] = lambda df: df,
        upto=None, first_takes_unordered: bool = False,
    ) -> int:
        """Process the rows of source above each stream's watermark, up to the limit fixed now, and commit.

        seq grows within a stream; streams may be null. Rows without seq can't be ordered: the first run takes them with
        first_takes_unordered, else no run does. The limit is each stream's highest seq, or upto where that is lower. Limits are written
        before anything is processed, and both the rows and the new watermarks come from what was written, so rows
        that arrive while the run is working, even if source is read anew by each job or is a function that reads it,
        are above the limit and belong to the next run. The lowest watermark and the highest limit reach the scan as literals.
        """
        read = source if callable(source) else lambda: source
        before_run, before = self.manifest(), self.marks()
        names, lows = [f"_s{i}" for i in range(len(stream))], [f"_m{i}" for i in range(len(stream))]
        kind = read().schema[seq].dataType
        below = F.lit(True) if upto is None else F.col(seq) <= literal(upto, kind)
        tops = read().where(F.col(seq).isNotNull() & below).groupBy(*stream).agg(F.max(seq).alias("_top"))
        bounds = tops.select(*[F.col(c).alias(n) for c, n in zip(stream, names)], "_top")
        if before is None:
            bounds = bounds.withColumn("_low", F.lit(None).cast(kind))
        else:
            own = before.select(*[F.col(c).alias(n) for c, n in zip(stream, lows)], F.col("mark").alias("_low"))
            same = reduce(and_, (F.col(n).eqNullSafe(F.col(m)) for n, m in zip(names, lows)), F.lit(True))
            both = bounds.withColumn("_in", F.lit(True)).join(own.withColumn("_had", F.lit(True)), same, "full_outer")
            keep = [F.when(F.col("_in"), F.col(n)).otherwise(F.col(m)).alias(n) for n, m in zip(names, lows)]
            bounds = both.select(*keep, F.greatest("_top", "_low").alias("_top"), "_low")
        at, seen = attempt(before_run["run"] + 1), Observation()
        told = [F.min("_low").alias("low"), F.count_if(F.col("_low").isNull()).alias("new"), F.max("_top").alias("high")]
        # what is written as the limits are the watermarks that this run commits
        limits = staged(bounds.observe(seen, *told).select(*[F.col(n).alias(c) for c, n in zip(stream, names)], F.col("_top").alias("mark"), "_low"), self.folder, f"marks/{at}")
        limits = limits.select(*[F.col(c).alias(n) for c, n in zip(stream, names)], F.col("mark").alias("_top"), "_low")
        low, new_streams, high = (observed(seen, x, None) for x in ("low", "new", "high"))
        rows = read()
        unordered = before is None and first_takes_unordered
        inside = F.lit(True) if high is None else F.col(seq) <= literal(high, kind)
        if low is not None and not new_streams:
            inside = inside & (F.col(seq) > literal(low, kind))
        rows = rows.where(F.col(seq).isNull() | inside) if unordered else rows.where(F.col(seq).isNotNull() & inside)
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(stream, names)), F.lit(True))
        ordered = same & (F.col(seq) <= F.col("_top")) & (F.col("_low").isNull() | (F.col(seq) > F.col("_low")))
        if unordered:
            todo = rows.join(limits, same, "left").where(F.col(seq).isNull() | ordered)
        else:
            todo = rows.join(limits, ordered)
        return self.commit(step(todo.drop("_top", "_low", *names)), at, before_run)


def log_runs(log: DataFrame) -> DataFrame:
    """(ns_name, stretch, lo, hi): the unbroken runs of LSNs that each stretch of each log holds. A null lsn is no record."""
    own = log.where(F.col("lsn").isNotNull()).select("ns_name", F.floor(F.col("lsn") / STRETCH).alias("stretch"), "lsn").distinct()
    w = W.partitionBy("ns_name", "stretch").orderBy("lsn")
    return (
        own.withColumn("island", F.col("lsn") - F.row_number().over(w))
        .groupBy("ns_name", "stretch", "island")
        .agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi"))
        .drop("island")
    )


def _stretches(ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each range cut at the ends of the stretches; empty ranges give nothing."""
    first, last = F.floor(F.col(lo) / STRETCH), F.floor(F.col(hi) / STRETCH)
    cut = ranges.where(F.col(lo) <= F.col(hi)).withColumn("stretch", F.explode(F.sequence(first, last)))
    return cut.withColumn(lo, F.greatest(F.col(lo), F.col("stretch") * STRETCH)).withColumn(hi, F.least(F.col(hi), F.col("stretch") * STRETCH + STRETCH - 1))


def marks_of(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """(consumer_id, ns_name, lo, hi): the stretch of its log that a follower has asked for, by requests of any outcome,
    within what the log holds. hi is the upper limit of this run."""
    asked = requests.groupBy("consumer_id", "ns_name").agg(
        F.min("start_lsn").alias("lo"), F.max("latest_lsn").alias("hi"), F.bool_or(F.col("start_lsn").isNull()).alias("from_first")
    )
    held = bounds.select(F.col("ns_name").alias("b_ns"), "first_lsn", "last_lsn")
    # least and greatest skip nulls, so a follower none of whose requests has an upper limit is left out first
    return asked.where("hi IS NOT NULL").join(held, F.col("ns_name").eqNullSafe(F.col("b_ns"))).select(
        "consumer_id",
        "ns_name",
        F.when(F.col("from_first") | F.col("lo").isNull(), F.col("first_lsn")).otherwise(F.greatest("lo", "first_lsn")).alias("lo"),
        F.least("hi", "last_lsn").alias("hi"),
    )


def outstanding(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records each follower still has to process, (consumer_id, ns_name, lsn), and its watermarks, (.., lo, hi).

    A follower's records go from its lowest start_lsn to its highest latest_lsn; those in a range of an ok
    request are done. A null start_lsn means the first record the log holds. A null latest_lsn sets no limit
    and finishes nothing; ranges that end before they start are empty. Repeats and disorder don't matter.

    Everything is cut into stretches of LSNs. A follower, namespace or range with most of the rows is thus spread over
    many groups, and repeated ranges combine before they are shuffled.
    """
    return outstanding_in(log_runs(log), requests)


def outstanding_in(runs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of the records in runs (ns_name, stretch, lo, hi). Every record is decided by the requests alone: a null
    start_lsn only means that there is no lower limit, so any part of a log gives its part of the result."""
    bounds = runs.groupBy("ns_name").agg(F.min("lo").alias("first_lsn"), F.max("hi").alias("last_lsn"))
    marks = marks_of(requests, bounds)
    who = ["consumer_id", "ns_name"]

    held = bounds.select(F.col("ns_name").alias("b_ns"), "first_lsn", "last_lsn")
    done = (
        requests.where((F.col("outcome") == "ok") & F.col("latest_lsn").isNotNull())
        .groupBy(*who, "start_lsn")
        .agg(F.max("latest_lsn").alias("hi"))
        .join(held, F.col("ns_name").eqNullSafe(F.col("b_ns")))
        .select(*who, F.greatest(F.coalesce("start_lsn", "first_lsn"), "first_lsn").alias("lo"), F.least("hi", "last_lsn").alias("hi"))
    )
    done = _stretches(done, "lo", "hi").groupBy(*who, "stretch", "lo").agg(F.max("hi").alias("hi"))
    spans = _stretches(marks, "lo", "hi")
    # Two ends, one just before and one just after what was asked for in the stretch: what no range covers lies between two neighbours.
    ends = spans.select(*who, "stretch", F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("lo")).withColumn("hi", F.col("lo"))
    w = W.partitionBy(*who, "stretch").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    gaps = (
        done.select(*who, "stretch", "lo", "hi").unionByName(ends.select(*who, "stretch", "lo", "hi"))
        .withColumn("covered", F.max("hi").over(w))
        .where(F.col("lo") > F.col("covered") + 1)
        .select(*who, "stretch", (F.col("covered") + 1).alias("from_lsn"), (F.col("lo") - 1).alias("to_lsn"))
    )
    r = runs.select(F.col("ns_name").alias("r_ns"), F.col("stretch").alias("r_stretch"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    found = gaps.join(
        r,
        F.col("ns_name").eqNullSafe(F.col("r_ns")) & (F.col("stretch") == F.col("r_stretch")) & (F.col("r_lo") <= F.col("to_lsn")) & (F.col("r_hi") >= F.col("from_lsn")),
    )
    lsn = F.explode(F.sequence(F.greatest("from_lsn", "r_lo"), F.least("to_lsn", "r_hi"))).alias("lsn")
    return found.select(*who, lsn), marks


def new_records(store: IncrementalStore, rows: DataFrame, name: str = "seen") -> tuple[DataFrame, str]:
    """(ns_name, stretch, lo, hi) of the records in rows that no committed run of the store has had, written to the store; and the
    name of what was written, which the store must commit under name so that later runs know them.

    A repeated lsn of a namespace is the same record, whenever it arrives again. Only stretches that rows touch are compared, as
    bitmaps of the unbroken runs that earlier runs wrote.
    """
    own = rows.where(F.col("lsn").isNotNull()).select("ns_name", "lsn", F.floor(F.col("lsn") / STRETCH).alias("stretch"))
    seen = store.part(name)
    if seen is not None:
        touched = own.select(F.col("ns_name").alias("t_ns"), F.col("stretch").alias("t_stretch")).distinct()
        s = seen.join(touched, F.col("ns_name").eqNullSafe(F.col("t_ns")) & (F.col("stretch") == F.col("t_stretch")), "left_semi")
        s = s.select(F.col("ns_name").alias("s_ns"), F.col("stretch").alias("s_stretch"), F.explode(F.sequence("lo", "hi")).alias("n"))
        s = s.groupBy("s_ns", "s_stretch").agg(F.bitmap_construct_agg(F.col("n") - F.col("s_stretch") * STRETCH).alias("bits"))
        known = F.coalesce(bitmaps.is_set(F.col("bits"), F.col("lsn") - F.col("stretch") * STRETCH), F.lit(False))
        own = own.join(s, F.col("ns_name").eqNullSafe(F.col("s_ns")) & (F.col("stretch") == F.col("s_stretch")), "left").where(~known)
    at = attempt(store.manifest()["run"] + 1)
    return staged(log_runs(own), store.folder, f"{name}/{at}"), at


def outstanding_step(store: IncrementalStore, requests: DataFrame) -> Callable[[DataFrame], dict]:
    """A step for IncrementalStore.run over a log: of the records that are new, those that followers still have to process,
    (consumer_id, ns_name, lsn). No run repeats a record that an earlier one had."""

    def step(rows: DataFrame) -> dict:
        runs, at = new_records(store, rows)
        return {"out": outstanding_in(runs, requests)[0], "seen": at}

    return step
