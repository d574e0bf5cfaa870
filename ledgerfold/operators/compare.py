"""Differences between two copies of a table: a null-safe full outer join on the key, and the fields that differ."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import nulls
from ..session import staged, work_folder

#: The field under which a key is reported whose unequal rows are other combinations of values that both sides have.
ROWS = "rows"


def one_per_key(rows: DataFrame, keys: list[str], fields: list[str], mark: str) -> DataFrame:
    """One row per key with non-null join columns (_nullsafe_n0, _nullsafe_k0, ...), its greatest row's fields as a struct named
    mark, and whether it has unequal rows, as mark_many.

    Rows compare by fields in their order with nulls lowest. The aggregation combines before it shuffles, so a key with many
    repeats is no hot spot, and it leaves the rows where the join needs them.
    """
    ranked = F.struct(*[x for i, f in enumerate(fields) for x in (F.col(f).isNotNull().alias(f"h{i}"), F.col(f).alias(f"v{i}"))])
    grouped = rows.select(*nulls.split(rows, keys), ranked.alias("r")).groupBy(*nulls.names(keys))
    values = F.struct(*[F.col(f"_best.v{i}").alias(f"v{i}") for i in range(len(fields))]).alias(mark)
    return grouped.agg(F.max("r").alias("_best"), F.min("r").alias("_least")).select("*", values, (F.col("_best") != F.col("_least")).alias(f"{mark}_many")).drop("_best", "_least")


def text_of(value: Column, kind: T.DataType) -> Column:
    """A field's value as text for the report: bytes as hexadecimal digits."""
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def difference(field: str, left: Column, right: Column, kind: T.DataType) -> Column:
    return F.struct(F.lit(field).alias("field"), text_of(left, kind).alias("left_value"), text_of(right, kind).alias("right_value"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], normalise: dict[str, Column] | None = None) -> DataFrame:
    """(keys, in_left, in_right, diffs): a row for each key that one side lacks or whose fields differ.

    diffs is an array of (field, left_value, right_value), empty for a key that one side lacks. Two nulls are equal, null
    and an empty value aren't. normalise: expressions over a side's columns that replace the fields before they are
    compared. Columns other than keys and fields are ignored. Keys may be null. Empty sides are allowed. Rows repeated exactly
    count once.

    A key that has unequal rows on a side is compared as a set: a field differs if one side has values of it that the other
    lacks, and the least such value of either side is told. If no field does, but the rows are other combinations, the field
    is 'rows', with null values.

    The join is made here and what differs is written to the shared folder; only if it holds keys with unequal rows are the rows
    of these keys read again.
    """
    normalise = normalise or {}
    made = lambda df: df.select(*keys, *[normalise[f].alias(f) if f in normalise else F.col(f) for f in fields])
    left, right = made(left), made(right)
    kinds = {f.name: f.dataType for f in left.schema.fields}
    joined = one_per_key(left, keys, fields, "l").join(one_per_key(right, keys, fields, "r"), nulls.names(keys), "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    unequal = ~reduce(and_, (F.col(f"l.v{i}").eqNullSafe(F.col(f"r.v{i}")) for i in range(len(fields))), F.lit(True))
    many = both & (F.coalesce("l_many", F.lit(False)) | F.coalesce("r_many", F.lit(False)))
    found = staged(joined.withColumn("many", many).where(~both | unequal | F.col("many")).drop("l_many", "r_many"), work_folder(left.sparkSession, "compare"), "found")
    each = [F.when(~F.col(f"l.v{i}").eqNullSafe(F.col(f"r.v{i}")), difference(f, F.col(f"l.v{i}"), F.col(f"r.v{i}"), kinds[f])) for i, f in enumerate(fields)]
    diffs = F.when(both, F.array_compact(F.array(*each))).otherwise(F.filter(F.array(*each), lambda _: F.lit(False)))
    out = found.where("NOT many").select(*nulls.joined(keys), F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"), diffs.alias("diffs"))
    sets = found.where("many").select(*nulls.names(keys))
    return out if sets.isEmpty() else out.unionByName(set_differences(left, right, keys, fields, sets))


def set_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], of: DataFrame) -> DataFrame:
    """differences() of keys with unequal rows; of holds the keys as nulls.split() gives them.

    Every value of every field, and every whole row, is grouped by key and value, and those of one side only by key and
    field: both combine before they shuffle, and no key's rows are gathered.
    """
    kinds, names = {f.name: f.dataType for f in left.schema.fields}, nulls.names(keys)
    wanted = of.select(*[F.col(n).alias(f"_of_{n}") for n in names])

    def values(df: DataFrame, is_left: bool) -> DataFrame:
        own = df.select(*nulls.split(df, keys), *[F.col(f).alias(f"_v{i}") for i, f in enumerate(fields)])
        own = own.join(wanted, [F.col(n) == F.col(f"_of_{n}") for n in names], "left_semi")
        cell = lambda i, f: F.struct(F.lit(i).alias("no"), text_of(F.col(f"_v{i}"), kinds[f]).alias("value"), F.lit(None).cast("binary").alias("whole"))
        # a whole row is told from others by its fields as JSON, in which null and empty differ
        text = F.to_json(F.struct(*[text_of(F.col(f"_v{i}"), kinds[f]).alias(f"v{i}") for i, f in enumerate(fields)]))
        row = F.struct(F.lit(-1).alias("no"), F.lit(None).cast("string").alias("value"), text.cast("binary").alias("whole"))
        return own.select(*names, F.explode(F.array(*[cell(i, f) for i, f in enumerate(fields)], row)).alias("c"), F.lit(is_left).alias("is_left")).select(*names, "c.*", "is_left")

    sides = values(left, True).unionByName(values(right, False)).groupBy(*names, "no", "value", "whole").agg(F.bool_or("is_left").alias("l"), F.bool_or(~F.col("is_left")).alias("r"))
    one_sided = sides.where("NOT (l AND r)").groupBy(*names, "no").agg(F.min(F.when(F.col("l"), F.col("value"))).alias("left_value"), F.min(F.when(F.col("r"), F.col("value"))).alias("right_value"))
    label = F.get(F.array(*[F.lit(f) for f in fields]), F.col("no"))
    told = one_sided.select(*names, "no", F.struct(F.when(F.col("no") < 0, F.lit(ROWS)).otherwise(label).alias("field"), "left_value", "right_value").alias("d"))
    # by key there are at most as many as there are fields
    lists = told.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("no", "d"))).alias("ds"))
    no_rows = F.filter("ds", lambda x: x["no"] >= 0)
    diffs = F.transform(F.when(F.size(no_rows) > 0, no_rows).otherwise(F.col("ds")), lambda x: x["d"])
    return lists.select(*nulls.joined(keys), F.lit(True).alias("in_left"), F.lit(True).alias("in_right"), diffs.alias("diffs"))
