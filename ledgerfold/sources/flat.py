"""FlatBuffers tables as the log's records use them: reading any, and writing simple ones.

A buffer begins with the place of its root table. A table begins with the distance back to its vtable, which lists where
each field stands; a field that isn't listed has its default, zero or nothing.
"""

from __future__ import annotations

import struct

#: Sizes of scalar fields, by struct's letters.
SCALARS = {"B": 1, "I": 4, "Q": 8}


class Table:
    def __init__(self, data: bytes, at: int | None = None):
        self.data = data
        self.at = struct.unpack_from("<I", data, 0)[0] if at is None else at
        self.vtable = self.at - struct.unpack_from("<i", data, self.at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, field: int) -> int | None:
        entry = 4 + 2 * field
        if entry + 2 > self.size:
            return None
        offset = struct.unpack_from("<H", self.data, self.vtable + entry)[0]
        return self.at + offset if offset else None

    def scalar(self, field: int, letter: str) -> int:
        at = self.place(field)
        return 0 if at is None else struct.unpack_from("<" + letter, self.data, at)[0]

    def _follow(self, at: int) -> int:
        return at + struct.unpack_from("<I", self.data, at)[0]

    def bytes(self, field: int) -> bytes | None:
        """A string or vector of bytes; None if absent."""
        at = self.place(field)
        if at is None:
            return None
        at = self._follow(at)
        n = struct.unpack_from("<I", self.data, at)[0]
        if at + 4 + n > len(self.data):
            raise ValueError("vector beyond the buffer")
        return self.data[at + 4 : at + 4 + n]

    def tables(self, field: int) -> list[Table]:
        at = self.place(field)
        if at is None:
            return []
        at = self._follow(at)
        n = struct.unpack_from("<I", self.data, at)[0]
        return [Table(self.data, self._follow(at + 4 + 4 * i)) for i in range(n)]


def build(fields: list) -> bytes:
    """A buffer with one table. A field is None, (letter, number), bytes, or a list of tables, each a list of fields."""
    body = _table(fields)
    return struct.pack("<I", 4 + _vtable_size(fields)) + body


def _vtable_size(fields: list) -> int:
    return 4 + 2 * len(fields)


def _table(fields: list) -> bytes:
    """vtable, table, and behind them what the table points to."""
    inline, offsets, later = b"", [], []
    for f in fields:
        if f is None:
            offsets.append(0)
            continue
        offsets.append(4 + len(inline))
        if isinstance(f, tuple):
            inline += struct.pack("<" + f[0], f[1])
        else:
            later.append((4 + len(inline), f))
            inline += b"\0\0\0\0"
    table = bytearray(struct.pack("<i", _vtable_size(fields)) + inline)
    tail = b""
    for place, f in later:
        struct.pack_into("<I", table, place, len(table) + len(tail) - place)
        tail += _vector(f)
    head = struct.pack(f"<HH{len(fields)}H", _vtable_size(fields), len(table), *offsets)
    return head + bytes(table) + tail


def _vector(value) -> bytes:
    if isinstance(value, bytes):
        return struct.pack("<I", len(value)) + value
    slots, tail = [], b""
    base = 4 + 4 * len(value)
    for i, fields in enumerate(value):
        slots.append(base + len(tail) + _vtable_size(fields) - (4 + 4 * i))
        tail += _table(fields)
    return struct.pack(f"<I{len(value)}I", len(value), *slots) + tail
