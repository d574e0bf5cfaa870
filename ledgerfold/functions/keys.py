"""Typed keys, positions and LSN keys as bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The first byte of each kind of key, fixed values.
KINDS = {"FE": "KV", "FD": "Row", "FF": "Chunked", "FC": "System"}


def big_endian(number: Column, size: int) -> Column:
    """A non-negative number as bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * size, "0"))


def from_big_endian(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def reversed_bytes(data: Column, size: int) -> Column:
    return F.concat(*[F.substring(data, i, 1) for i in range(size, 0, -1)])


def kv_key(key: Column) -> Column:
    """The typed key; one that is typed already stays."""
    return F.when(F.substring(key, 1, 1) == F.unhex(F.lit("FE")), key).otherwise(F.concat(F.unhex(F.lit("FE")), key))


def row_key(row: Column) -> Column:
    return F.concat(F.unhex(F.lit("FD")), big_endian(F.octet_length(row), 4), row)


def cell_key(row: Column, column: Column) -> Column:
    return F.concat(row_key(row), column.cast("binary"))


def chunk_key(key: Column, chunk: Column) -> Column:
    return F.concat(F.unhex(F.lit("FF")), big_endian(F.octet_length(key), 4), key, big_endian(chunk, 4))


def system_key(name: Column) -> Column:
    return F.concat(F.unhex(F.lit("FC")), name.cast("binary"))


def kind_of(key: Column) -> Column:
    """The kind that a typed key's first byte names; null for other keys."""
    first = F.hex(F.substring(key, 1, 1))
    out = None
    for byte, name in KINDS.items():
        out = F.when(first == byte, name) if out is None else out.when(first == byte, name)
    return out


def lsn_key(lsn: Column) -> Column:
    return big_endian(lsn, 8)


def lsn_of(key: Column) -> Column:
    """The lsn of an 8-byte key; null for other lengths."""
    return F.when(F.octet_length(key) == 8, from_big_endian(key))


def encode_position(segment: Column, offset: Column) -> Column:
    """12 bytes: the segment in 4 and the offset in 8, the lowest byte first."""
    return F.concat(reversed_bytes(big_endian(segment, 4), 4), reversed_bytes(big_endian(offset, 8), 8))


def decode_position(data: Column) -> Column:
    """(segment_id, seg_offset) of a position's bytes; null if there are fewer than 12."""
    part = lambda at, n: from_big_endian(reversed_bytes(F.substring(data, at, n), n))
    return F.when(F.octet_length(data) >= 12, F.struct(part(1, 4).alias("segment_id"), part(5, 8).alias("seg_offset")))


# ---- keys as a store's driver makes them: what is typed already stays ----


def starts_with(key: Column, byte: str) -> Column:
    return F.substring(key, 1, 1) == F.unhex(F.lit(byte))


def stored_row_key(row: Column) -> Column:
    return F.when(starts_with(row, "FD"), row).otherwise(row_key(row))


def stored_cell_key(row: Column, column: Column) -> Column:
    return F.concat(stored_row_key(row), column.cast("binary"))


def stored_chunk_key(key: Column, chunk: Column) -> Column:
    """The first chunk of a key that is typed already keeps it."""
    return F.when(starts_with(key, "FF") & (chunk == 0), key).otherwise(chunk_key(key, chunk))


# ---- checkpoints ----


def encode_checkpoint(records: Column, segment: Column, offset: Column, index: Column, term: Column) -> Column:
    """36 bytes, the lowest first in each number: records processed, position, index and term of the consensus. A null position is all zeros."""
    number = lambda c: reversed_bytes(big_endian(c, 8), 8)
    return F.concat(number(records), F.coalesce(encode_position(segment, offset), F.unhex(F.lit("00" * 12))), number(index), number(term))


def decode_checkpoint(data: Column) -> Column:
    """(records, segment_id, seg_offset, raft_index, raft_term); of 20 bytes the last two are 0, of fewer all."""
    number = lambda at: from_big_endian(reversed_bytes(F.substring(data, at, 8), 8))
    p = decode_position(F.substring(data, 9, 12))
    has, long, zero = F.octet_length(data) >= 20, F.octet_length(data) >= 36, F.lit(0).cast("bigint")
    parts = {"records": (has, number(1)), "segment_id": (has, p["segment_id"]), "seg_offset": (has, p["seg_offset"]), "raft_index": (long, number(21)), "raft_term": (long, number(29))}
    return F.struct(*[F.when(there, value).otherwise(zero).alias(name) for name, (there, value) in parts.items()])
