"""Keys in which null equals null, as plain columns: joins and windows on them share one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def blank(kind: T.DataType) -> Column:
    """A stand-in for null; whether the value was null stands beside it."""
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.lit(""))
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind)


def names(keys: list[str]) -> list[str]:
    return [n for i in range(len(keys)) for n in (f"_nullsafe_n{i}", f"_nullsafe_k{i}")]


def split(df: DataFrame, keys: list[str]) -> list[Column]:
    """For each key whether it is null, as _nullsafe_n0 and so on, and a value that never is, as _nullsafe_k0 and so on."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [x for i, k in enumerate(keys) for x in (F.col(k).isNull().alias(f"_nullsafe_n{i}"), F.coalesce(F.col(k), blank(kinds[k])).alias(f"_nullsafe_k{i}"))]


def joined(keys: list[str]) -> list[Column]:
    """The keys again from what split() made."""
    return [F.when(~F.col(f"_nullsafe_n{i}"), F.col(f"_nullsafe_k{i}")).alias(k) for i, k in enumerate(keys)]
