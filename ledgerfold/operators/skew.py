"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Rows of each key are counted in each input block (a stretch of one input file).
2. A prefix sum over the blocks gives the offset at which a block's rows of a key begin.
3. offset + number within the block numbers the rows of each key, in input order, without gaps.
4. Stretches of chunk_rows numbers are folded, each by one task, whatever key they belong to.
5. The chunks' boundary states are merged in order.

No step gathers a key: a group holds at most the rows of a block, the rows of a chunk, or one state for each
block or chunk of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import nulls

BLOCK_ROWS = 1 << 17
CHUNK_ROWS = 1 << 16

#: Columns that this module adds to a caller's rows.
FILE, BLOCK, POS, NUMBER, CHUNK = "_skew_file", "_skew_block", "_skew_pos", "_skew_number", "_skew_chunk"


def positioned(rows: DataFrame, *columns: Column | str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns of a DataFrame read from files, with the place of each row: file, block of the file, row in the file.

    The place comes from the file and its row index, not from Spark's partitions, so it is the same however
    the files are split and however often a task is run.
    """
    index = F.col("_metadata.row_index")
    return rows.select(
        *columns, F.col("_metadata.file_path").alias(FILE), F.floor(index / block_rows).alias(BLOCK), index.alias(POS)
    )


def _slim(rows: DataFrame) -> DataFrame:
    """The file as a number. Were two files to get the same number, they would count as one, and only the order of their rows would change."""
    return rows.withColumn(FILE, F.xxhash64(FILE))


def block_offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file, block, n, offset): how many rows of a key a block has, and how many earlier blocks have; files count in order of their paths."""
    counts = (
        rows.select(*keys, F.xxhash64(FILE).alias("_file"), F.col(FILE), F.col(BLOCK))
        .groupBy(*keys, "_file", BLOCK)
        .agg(F.count("*").alias("n"), F.min(FILE).alias("_path"))
    )
    before = W.partitionBy(*keys).orderBy("_path", BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))
    return counts.select(*keys, F.col("_file").alias(FILE), BLOCK, "n", offset.alias("_skew_offset"))


def numbered(rows: DataFrame, keys: list[str], order: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows of positioned(), with the number of each row among the rows of its key, from 0, and its chunk.

    order: columns besides the place that order rows which came from one input row. Null keys are keys. The rows are
    shuffled once, by key and block, for the numbers in the block and the offsets alike.
    """
    rest = [c for c in rows.columns if c not in keys]
    place = [*nulls.names(keys), FILE, BLOCK]
    own = rows.select(*nulls.split(rows, keys), *rest)
    within = W.partitionBy(*place).orderBy(POS, *(order or []))
    first = _slim(own).withColumn("_skew_within", F.row_number().over(within) - 1)
    out = first.join(block_offsets(own, nulls.names(keys)).drop("n"), place).withColumn(NUMBER, F.col("_skew_offset") + F.col("_skew_within"))
    return out.withColumn(CHUNK, F.floor(F.col(NUMBER) / chunk_rows)).select(*nulls.joined(keys), *rest, NUMBER, CHUNK)


def running(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str, nullable: bool = True) -> DataFrame:
    """rows with name: the sum of value over the earlier rows of the same key, 0 for the first; with value 1, the row's number.

    block is a number that grows with order, such as a sequence number divided by some thousands. Sums run inside
    blocks, and the blocks' totals give each block its start, so a key with most of the rows is spread over its blocks. With
    nullable=False the keys have no nulls.
    """
    own = rows.select("*", *(nulls.split(rows, keys) if nullable else []), block.alias(BLOCK), value.alias("_skew_value"))
    names = nulls.names(keys) if nullable else keys
    place = [*names, BLOCK]
    inside = F.coalesce(F.sum("_skew_value").over(W.partitionBy(*place).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = own.groupBy(*place).agg(F.sum("_skew_value").alias("_skew_sum"))
    before = F.coalesce(F.sum("_skew_sum").over(W.partitionBy(*names).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*place, before.alias("_skew_start"))
    out = own.withColumn("_skew_inside", inside).join(starts, place)
    return out.withColumn(name, (F.col("_skew_start") + F.col("_skew_inside")).cast("bigint")).select(*rows.columns, name)


def chunk_states(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One state for each chunk of each key: n, nulls, changes, first, last.

    changes counts the rows whose value differs from that of the row before, two nulls being equal; first and last
    are the values at the chunk's ends, for the merge.
    """
    w = W.partitionBy(*keys, CHUNK).orderBy(NUMBER)
    step = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return (
        rows.withColumn("_step", step.cast("bigint"))
        .groupBy(*keys, CHUNK)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(value).isNull()).alias("nulls"),
            F.sum("_step").alias("changes"),
            F.min_by(F.struct(F.col(value).alias("v")), NUMBER).alias("first"),
            F.max_by(F.struct(F.col(value).alias("v")), NUMBER).alias("last"),
        )
    )


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, nulls, changes): the chunks' states merged in order, a change at a boundary counted once."""
    w = W.partitionBy(*keys).orderBy(CHUNK)
    before = F.lag("last").over(w)
    edge = F.when(before.isNotNull() & ~before.eqNullSafe(F.col("first")), 1).otherwise(0)
    return (
        states.withColumn("_edge", edge.cast("bigint"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), (F.sum("changes") + F.sum("_edge")).alias("changes"))
    )


def per_key(rows: DataFrame, keys: list[str], value: str, order: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, nulls, changes) for every key of positioned() rows, null keys included; an empty table gives no row."""
    return merged_states(chunk_states(numbered(rows, keys, order, chunk_rows), keys, value), keys)


def heavy(results: DataFrame, share: int, within: list[str]) -> DataFrame:
    """The keys of per_key() that hold at least one share-th of all rows with the same within columns.

    within names tables or kinds, of which there are a few; their totals, one row each, are broadcast.
    """
    totals = results.groupBy(*within).agg(F.sum("n").alias("_total"))
    return results.join(F.broadcast(totals), within).where(F.col("n") * share >= F.col("_total")).drop("_total")
