"""How texts go to Python: Arrow batches of few rows and bytes, so that a batch of long texts stays small."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..session import ship

#: Most rows and bytes that are worked on at once. A longer text is worked on alone.
ROWS, BYTES = 1000, 16 << 20


def small_batches(df: DataFrame) -> Texts:
    """df, ready for mapInArrow with batches of at most ROWS rows and BYTES bytes; executors have this package."""
    ship(df.sparkSession)
    return Texts(df)


class Texts:
    def __init__(self, df: DataFrame):
        self.df = df

    def mapInArrow(self, run, schema: str) -> DataFrame:
        return self.df.mapInArrow(lambda batches: run(cut(batches)), schema)


def cut(batches: Iterator, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """The batches in slices of at most so many rows and bytes, or of one row. Batches themselves end at
    spark.sql.execution.arrow.maxBytesPerBatch."""
    for batch in batches:
        at = 0
        while at < max(batch.num_rows, 1):
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += max(n, 1)
