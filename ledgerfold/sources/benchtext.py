"""Text that benchmarks leave: CSV of a load generator, a runtime's garbage collection trace, benchmark lines, relayer logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def _part(pattern: str, group: int, kind: str = "double") -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit("")).try_cast(kind)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """(test, rps, p50_ms) of a CSV with a header; lines whose numbers aren't numbers are left out."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().strip('"').lower(): c for c in raw.columns}
    col = lambda name: F.col(f"`{names[name]}`")
    out = raw.select(col("test").alias("test"), col("rps").try_cast("double").alias("rps"), col("p50_latency_ms").try_cast("double").alias("p50_ms"))
    return out.where("rps IS NOT NULL AND p50_ms IS NOT NULL")


#: A line of the trace: cycle, time, CPU share, pauses, heap sizes, goal. Fixed pattern of the runtime's format.
GC = r"gc (\d+) @([\d.]+)s (\d+)%: ([\d.]+)\+([\d.]+)(?:\+([\d.]+))? ms clock, .* ms cpu, (\d+)->(\d+)->(\d+) MB, (\d+) MB goal"


def gc_trace(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, at_s, cpu_percent, pause_ms, concurrent_ms, heap_before, heap_after, goal_mb) of the lines that are trace lines."""
    return gc_lines(spark.read.text(path))


def gc_lines(lines: DataFrame) -> DataFrame:
    """The older form of a line has two times on the clock, both of them pauses."""
    found = lines.where(F.col("value").rlike(GC))
    old = _part(GC, 6).isNull()
    return found.select(
        _part(GC, 1, "bigint").alias("cycle"), _part(GC, 2).alias("at_s"), _part(GC, 3).alias("cpu_percent"), (_part(GC, 4) + F.when(old, _part(GC, 5)).otherwise(_part(GC, 6))).alias("pause_ms"),
        F.when(old, 0.0).otherwise(_part(GC, 5)).alias("concurrent_ms"), _part(GC, 7, "bigint").alias("heap_before"), _part(GC, 9, "bigint").alias("heap_after"), _part(GC, 10, "bigint").alias("goal_mb"),
    )


def gc_summary(trace: DataFrame) -> DataFrame:
    """Cycles, time span, mean and 95th percentile of the pauses."""
    return trace.agg(F.count("*").alias("n"), (F.max("at_s") - F.min("at_s")).alias("span_s"), F.avg("pause_ms").alias("mean_ms"), F.percentile("pause_ms", 0.95).alias("p95_ms"))


BENCH = r"^Benchmark(\S+?)(?:-\d+)?\s+(\d+)\s+([\d.]+) ns/op(?:\s+([\d.]+) MB/s)?"


def bench_lines(lines: DataFrame) -> DataFrame:
    """(name, n, ns_per_op, mb_per_s) of benchmark lines."""
    found = lines.where(F.col("value").rlike(BENCH))
    return found.select(F.regexp_extract("value", BENCH, 1).alias("name"), _part(BENCH, 2, "bigint").alias("n"), _part(BENCH, 3).alias("ns_per_op"), _part(BENCH, 4).alias("mb_per_s"))


def blocks(lines: DataFrame, order: str, heading: str, sample: str) -> DataFrame:
    """(heading, sample) of a log in blocks: each line that matches sample with the heading before it, by their first groups.

    Logs of this kind are a few megabytes, of one run each, and are ordered in one task.
    """
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract("value", heading, 1), F.lit(""))
    marked = lines.withColumn("heading", F.last(own, ignorenulls=True).over(w))
    return marked.where(F.col("value").rlike(sample)).select("heading", F.regexp_extract("value", sample, 1).alias("sample"))


def load_by_size(samples: DataFrame) -> DataFrame:
    """(relayers, op, rps, latency_ms): the means of (relayers, op, rps, latency_ms) samples by number of relayers and operation."""
    return samples.groupBy("relayers", "op").agg(F.avg("rps").alias("rps"), F.avg("latency_ms").alias("latency_ms"))


#: A line of the segment benchmark: access, segment and chunk size, mode, time. Fixed pattern of the format.
CHUNK_LINE = r"Benchmark\w*/(\w+)/segment_(\d+)MB/chunk_(\d+)KB/(\w+)\S*\s+\d+\s+(\d+) ns/op"
SMALL_KB = 16


def chunk_lines(lines: DataFrame) -> DataFrame:
    """(mode, chunk_kb, ns) of the lines of a segment benchmark; mode is access/mode."""
    found = lines.where(F.col("value").rlike(CHUNK_LINE))
    part = lambda i: F.regexp_extract("value", CHUNK_LINE, i)
    return found.select(F.concat_ws("/", part(1), part(4)).alias("mode"), part(3).cast("bigint").alias("chunk_kb"), part(5).cast("bigint").alias("ns"))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """(mode, is_small, mean_ms): mean times of chunks up to 16 KB and above."""
    return chunks.groupBy("mode", (F.col("chunk_kb") <= SMALL_KB).alias("is_small")).agg((F.avg("ns") / 1e6).alias("mean_ms"))
