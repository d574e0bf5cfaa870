"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Largest side, in bytes, that an operator broadcasts. Beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20


def session(app: str = "ledgerfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


class Folder:
    """A folder on any Hadoop file system, with the few calls that commits need."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._Path(self / name))

    def names(self, name: str = "") -> list[str]:
        at = self._Path(self / name if name else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._Path(self / name), True)

    def delete_at_end(self) -> None:
        """Have the driver delete this folder when it ends."""
        self._fs.deleteOnExit(self._Path(self.path))

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._Path(self / name), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._Path(self / name))
        try:
            utils = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return json.loads(utils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit_json(self, name: str, value: dict) -> None:
        """Write value under name in one atomic step; FileExistsError if name exists, so of two writers one wins.

        The file is written under another name first and then takes its own only if none has it: by a hard link on a local
        disk, by a rename on file systems where that never replaces a file, as on HDFS. Object stores, which have neither,
        create it on condition that it isn't there.
        """
        target, data = self._Path(self / name), json.dumps(value).encode()
        self._fs.mkdirs(target.getParent())
        scheme = self._fs.getUri().getScheme()
        if scheme in CONDITIONAL:
            if not self._create_if_absent(target, data):
                raise FileExistsError(self / name)
            return
        draft = self._Path(self / f".{uuid.uuid4().hex}.draft")
        self.write(draft.getName(), data)
        try:
            if not (self._linked(draft, target) if scheme == "file" else self._fs.rename(draft, target)):
                raise FileExistsError(self / name)
        finally:
            self._fs.delete(draft, False)

    def _linked(self, draft, target) -> bool:
        """Whether the local file target could be made a second name of draft; False if it exists."""
        jvm = self.spark.sparkContext._jvm
        path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(path(target), path(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def _create_if_absent(self, target, data: bytes) -> bool:
        builder = self._fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", True)
        try:
            stream = builder.build()
            stream.write(bytearray(data))
            stream.close()
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True


#: Schemes of object stores that can create a file on condition that it is absent.
CONDITIONAL = {"s3a", "abfs", "abfss", "gs"}


def attempt(number: int) -> str:
    """A folder name of its own for one attempt to write an epoch or run, so that no other attempt overwrites it."""
    return f"attempt={number}-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset and everything runs on this machine, one of
    this machine; on a cluster, whose executors don't see the driver's disk, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_ledgerfold_folder", None):
        context._ledgerfold_folder = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
    return context._ledgerfold_folder


def work_folder(spark: SparkSession, name: str) -> Folder:
    """A new folder for one run's intermediate tables, deleted when the driver ends."""
    folder = Folder(spark, f"{shared_folder(spark)}/ledgerfold/{name}-{uuid.uuid4().hex}")
    folder.delete_at_end()
    return folder


def staged(df: DataFrame, folder: Folder, name: str) -> DataFrame:
    """df written as a table in the folder and read again: its lineage ends there, and any executor can read it."""
    df.write.mode("overwrite").parquet(folder / name)
    return folder.spark.read.schema(df.schema).parquet(folder / name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_ledgerfold_shipped", False):
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    folder = work_folder(spark, "code")
    folder.write("ledgerfold.zip", data.getvalue())
    context.addPyFile(folder / "ledgerfold.zip")
    context._ledgerfold_shipped = True
