"""Backups of tables, and their restoration: checked first, dry or for good, whole or not at all.

A backup has a folder for each part and backup.json, which tells their rows and a sum over them. A restoration goes into a
folder of its own, is read again and compared, and takes effect by one atomic file; until then the target is as it was. One
restoration at a time holds the target's lock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..session import Folder, attempt
from .parts import observed


def fingerprint(rows: DataFrame) -> list:
    """How many rows there are, and the sum of a hash over each, which doesn't depend on their order."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("total")]


class Backup:
    """A backup in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def write(self, parts: dict[str, DataFrame]) -> dict:
        """Write each part, then the list of them; FileExistsError if there is a backup in the folder already."""
        if not parts:
            raise ValueError("nothing to back up")
        told = {}
        for name, rows in parts.items():
            at, seen = f"{name}/{attempt(1)}", Observation()
            rows.observe(seen, *fingerprint(rows)).write.parquet(self.folder / at)
            told[name] = {"at": at, "schema": rows.schema.json(), "rows": observed(seen, "n", 0), "total": observed(seen, "total", "0")}
        self.folder.commit_json("backup.json", told)
        return told

    def parts(self) -> dict:
        if not self.folder.exists("backup.json"):
            raise ValueError(f"no backup in {self.folder.path}")
        return self.folder.read_json("backup.json")

    def read(self, name: str) -> DataFrame:
        return _read(self.spark, self.folder, self.parts()[name])

    def check(self, names: list[str] | None = None) -> dict:
        """The parts, those named or all; ValueError for a part that is missing or isn't what was written."""
        held = self.parts()
        for name in names or held:
            if name not in held:
                raise ValueError(f"the backup has no {name}")
            _compare(self.spark, self.folder, held[name], name)
        return {n: held[n] for n in names or held}

    def restore(self, target: str, names: list[str] | None = None, dry_run: bool = False) -> DataFrame:
        """(part, action, n_rows, path): what was restored, or with dry_run would be, after the same check; then nothing is written.

        Parts that target has besides stay. If anything fails, target is as it was.
        """
        to, held = Folder(self.spark, target), self.check(names)
        done = restored_numbers(to)
        now = to.read_json(f"restored/{done[-1]}.json") if done else {}
        number, action = (done[-1] if done else 0) + 1, "would restore" if dry_run else "restored"
        at = {name: f"{name}/{attempt(number)}" for name in held}
        if not dry_run:
            to.commit_json("restore.lock", {"number": number})
            try:
                for name, part in held.items():
                    self.read(name).write.parquet(to / at[name])
                    _compare(self.spark, to, part | {"at": at[name]}, name)
                to.commit_json(f"restored/{number}.json", now | {n: p | {"at": at[n]} for n, p in held.items()})
            except BaseException:
                for path in at.values():
                    to.delete(path)
                raise
            finally:
                to.delete("restore.lock")
        return self.spark.createDataFrame([(n, action, p["rows"], to / at[n]) for n, p in held.items()], "part string, action string, n_rows bigint, path string")


def restored_numbers(to: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in to.names("restored") if n.endswith(".json"))


def restored(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A part as the last restoration left it."""
    to = Folder(spark, target)
    return _read(spark, to, to.read_json(f"restored/{restored_numbers(to)[-1]}.json")[name])


def _read(spark: SparkSession, folder: Folder, part: dict) -> DataFrame:
    import json

    return spark.read.schema(T.StructType.fromJson(json.loads(part["schema"]))).parquet(folder / part["at"])


def _compare(spark: SparkSession, folder: Folder, part: dict, name: str) -> None:
    if not folder.exists(part["at"]):
        raise ValueError(f"{name} is missing")
    rows = _read(spark, folder, part)
    n, total = rows.agg(*fingerprint(rows)).first()
    if (n, total) != (part["rows"], part["total"]):
        raise ValueError(f"{name} isn't what was written: {n} rows for {part['rows']}")
