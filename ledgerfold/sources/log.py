"""The log as a table: reading it at once or as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = (
    "ns_name string, segment_id bigint, seg_offset bigint, lsn bigint, hlc bigint, crc32_checksum bigint, operation_type string, txn_state string, "
    "entry_type string, txn_id binary, prev_txn_wal_index binary, entries array<struct<entry_key:binary,entry_value:binary,cells:map<string,binary>>>, "
    "ingested_at timestamp_ntz"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log in Parquet files. Columns that are absent are null; others than LOG's are left out."""
    return spark.read.schema(LOG).parquet(path)


def follow(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The same as a stream: what is there, then what is added. The checkpoint of the query that reads it holds the place."""
    return follow_files(spark, path, LOG, files_per_batch)


def follow_files(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files in a folder, or of a single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path)
