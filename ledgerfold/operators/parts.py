"""Tables kept as parts: folders that a manifest names, cut into buckets so that a run reads and rewrites only what it touches.

Every attempt at an epoch writes folders of its own, so a failed or beaten attempt never overwrites what another has
committed; the manifest commits/E.json is created only if it isn't there. Parts with a sort order are cut into buckets
by the hash of some columns, a sub-folder each, and sorted inside.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from ..functions import bitmaps
from ..session import BROADCAST_BYTES, Folder


class PartStore:
    #: The schema of each part; of bucketed ones it ends in bucket int.
    PARTS: dict[str, str] = {}
    #: What bucketed parts are sorted by.
    SORTED: dict[str, list[str]] = {}
    #: Parts of which each bucket stands in one folder only and is rewritten when touched; the others are united from all their folders.
    HELD: set[str] = set()

    def __init__(self, spark: SparkSession, path: str, broadcast_bytes: int = BROADCAST_BYTES, buckets: int = 16):
        if not 0 < buckets <= bitmaps.BITS:
            raise ValueError(f"from 1 to {bitmaps.BITS} buckets")
        self.spark, self.folder, self.broadcast_bytes, self.buckets = spark, Folder(spark, path), broadcast_bytes, buckets

    def epochs(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("commits") if n.endswith(".json"))

    def manifest(self) -> dict:
        """The folders of each part; of held ones the folder of each bucket."""
        done = self.epochs()
        if done:
            return self.folder.read_json(f"commits/{done[-1]}.json")
        return {"epoch": 0, "buckets": self.buckets} | {p: {} if p in self.HELD else [] for p in self.PARTS}

    def commit(self, manifest: dict) -> int:
        self.folder.commit_json(f"commits/{manifest['epoch']}.json", manifest)
        return manifest["epoch"]

    def empty(self, part: str) -> DataFrame:
        return self.spark.createDataFrame([], self.PARTS[part])

    def read_part(self, part: str, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        """A part, of given buckets only, whose folders alone are then scanned."""
        if not folders or buckets == []:
            return self.empty(part)
        rows = self.read_paths(part, folders)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read_paths(self, part: str, paths: list[str], schema: str | None = None) -> DataFrame:
        schema = schema or self.PARTS[part]
        return self.files_of(part, paths, schema).select(*T.StructType.fromDDL(schema).names)

    def files_of(self, part: str, paths: list[str], schema: str) -> DataFrame:
        """Folders of a part as they are read from files, in one scan, with the place of each row in _metadata."""
        return self.spark.read.schema(schema).option("basePath", self.folder / part).parquet(*[self.folder / f"{part}/{p}" for p in paths])

    def read_held(self, part: str, now: dict, buckets: list[int] | None = None) -> DataFrame:
        """A held part, of given buckets only."""
        wanted = None if buckets is None else set(buckets)
        held = {int(b): f for b, f in now[part].items() if wanted is None or int(b) in wanted}
        if not held:
            return self.empty(part)
        if len(set(held.values())) == 1:
            return self.read_part(part, [next(iter(held.values()))], sorted(held))
        return self.read_paths(part, [f"{f}/bucket={b}" for b, f in sorted(held.items())])

    def write_part(self, df: DataFrame, part: str, folder: str, touched: Column | None = None) -> list[int] | None:
        """Write one folder of a part. touched is a number below 32,768, whose distinct values come back."""
        seen = Observation()
        if touched is not None:
            df = df.observe(seen, F.bitmap_construct_agg(touched.cast("bigint")).alias("touched"))
        if part in self.SORTED:
            df.repartition("bucket").sortWithinPartitions("bucket", *self.SORTED[part]).write.option("compression", "zstd").partitionBy("bucket").parquet(self.folder / f"{part}/{folder}")
        else:
            df.write.parquet(self.folder / f"{part}/{folder}")
        return numbers_of(observed(seen, "touched", None)) if touched is not None else None

    @staticmethod
    def held_after(before: dict[str, str], rewritten: list[int], folder: str, written: list[int]) -> dict[str, str]:
        """The folders of a held part's buckets after some were rewritten, of which only those written still have rows."""
        gone = set(rewritten)
        return {b: f for b, f in before.items() if int(b) not in gone} | {str(b): folder for b in written}

    def vacuum(self) -> None:
        """Remove the folders of this and earlier epochs that the last manifest doesn't name; those of an epoch that is
        being written are later ones."""
        now = self.manifest()
        for part in self.PARTS:
            named = set(now[part].values()) if part in self.HELD else set(now[part])
            for folder in self.folder.names(part):
                if folder not in named and epoch_of(folder) <= now["epoch"]:
                    self.folder.delete(f"{part}/{folder}")


def at_once(*jobs: Callable[[], object]) -> list:
    """The results of jobs that don't depend on each other, run side by side, so that one's last tasks don't hold up another's first."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def observed(observation: Observation, name: str, empty):
    """What was observed of the rows that are written or returned; empty where Spark knew them to be none and left out the plan with
    its observation. What is observed further inside a plan can be left out with rows that there are, and is of no use."""
    try:
        return observation.get[name]
    except Py4JJavaError as e:
        if "AssertionError" in str(e.java_exception.getClass()):
            return empty
        raise


def epoch_of(folder: str) -> int:
    return int(folder.partition("=")[2].partition("-")[0])


def bucket_of(columns: list[str], now: dict) -> Column:
    """The bucket of a row in a store whose manifest is now."""
    return F.pmod(F.xxhash64(*columns), F.lit(now["buckets"])).cast("int")


def numbers_of(bits: bytes | None) -> list[int]:
    """The places of the bits that are set."""
    return [8 * i + k for i, byte in enumerate(bits or b"") if byte for k in range(8) if byte >> k & 1]


def dense(rows: DataFrame, name: str, start: int) -> DataFrame:
    """rows read from files with name: start, start + 1 and so on without a gap, by file and row. What is ordered in one
    task is one count for each file."""
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    offsets = counts.select("_file", (F.sum("_n").over(W.orderBy("_file")) - F.col("_n")).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_file").withColumn(name, F.lit(start).cast("bigint") + F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")
