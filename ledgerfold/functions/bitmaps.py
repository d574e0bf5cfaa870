"""Bitmaps of 32,768 bits, as bitmap_construct_agg and bitmap_or_agg make them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 32768
BYTES = BITS // 8


def bucket(number: Column) -> Column:
    """Which bitmap holds the number; negative numbers too."""
    return F.shiftright(number, 15)


def bit(number: Column) -> Column:
    """The number's place in its bitmap."""
    return number.bitwiseAND(F.lit(BITS - 1).cast("bigint"))


def is_set(bitmap: Column, place: Column) -> Column:
    """True if the bit at place is set; null for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, place.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1
