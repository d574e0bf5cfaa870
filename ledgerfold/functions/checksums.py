"""CRC-32C, which Spark has no function for, over Arrow batches. CRC-32 (IEEE) is F.crc32."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T

POLYNOMIAL = 0x82F63B78


@lru_cache(maxsize=1)
def table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


def crc32c(data: bytes) -> int:
    crc, t = 0xFFFFFFFF, table()
    for byte in data:
        crc = (crc >> 8) ^ t[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes | None]) -> list[int | None]:
    """CRC-32C of many byte strings at once: byte i of all of them in one step, so the loop is over the longest only."""
    import numpy as np

    t = np.array(table(), np.uint32)
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    lengths = np.array([len(values[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(order) else lengths
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    live, place = len(order), 0
    while live:
        while live and lengths[live - 1] <= place:
            live -= 1
        if live:
            c = crc[:live]
            crc[:live] = (c >> np.uint32(8)) ^ t[(c ^ flat[starts[:live] + place]) & np.uint32(0xFF)]
        place += 1
    out: list[int | None] = [None] * len(values)
    for i, c in zip(order, (crc ^ np.uint32(0xFFFFFFFF)).tolist()):
        out[i] = c
    return out


def crc32c_column(data: Column) -> Column:
    """The CRC-32C of binary values as bigint; null for null."""

    @F.pandas_udf(T.LongType())
    def run(values):
        import pandas as pd

        return pd.Series(crc32c_many([None if v is None else bytes(v) for v in values]), dtype="Int64")

    return run(data)
