"""Envelopes in which a consensus log carries records: read, made, and given their number, as expressions over bytes.

An envelope is term (8 bytes), index (8), type (1), time of appending in nanoseconds (8), the length of the data as a varint, the
data, the length of the extensions as a varint, the extensions; numbers have their lowest byte first. Only envelopes of type
COMMAND carry a record; the others stand for a placeholder with the envelope's index, so that the sequence has no hole.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import big_endian, from_big_endian, reversed_bytes

HEAD, COMMAND = 25, 0
#: Bytes of a length that are read: lengths up to 2^35.
VARINT = 5


def number_at(data: Column, at: Column | int, size: int) -> Column:
    """The number in size bytes from the 0-based place at on, the lowest byte first."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.substring(data, (at + 1 + i).cast("int"), F.lit(1))
    return from_big_endian(F.concat(*[byte(i) for i in range(size - 1, -1, -1)]))


def varint(number: Column) -> Column:
    """A number below 2^35 as a varint."""
    size = F.lit(1)
    for k in range(1, VARINT):
        size = F.when(number >= (1 << 7 * k), k + 1).otherwise(size)
    byte = lambda k: F.unhex(F.lpad(F.hex((F.shiftright(number, 7 * k).bitwiseAND(F.lit(127).cast("bigint")) + F.when(size > k + 1, 128).otherwise(0)).cast("bigint")), 2, "0"))
    return F.substring(F.concat(*[byte(k) for k in range(VARINT)]), F.lit(1), size.cast("int"))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def varint_at(data: Column, at: Column) -> Column:
    """(value, behind) of the varint at a 0-based place; null if it doesn't end within VARINT bytes or the data."""

    def read(x: Column) -> Column:
        byte = lambda k: F.get(x["bytes"], F.lit(k))
        out = F.lit(None).cast("struct<value:bigint,behind:bigint>")
        for k in range(VARINT - 1, -1, -1):
            whole = sum((F.shiftleft(byte(j).bitwiseAND(F.lit(127).cast("bigint")), 7 * j) for j in range(k + 1)), F.lit(0).cast("bigint"))
            out = F.when((x["left"] > k) & (byte(k) < 128), F.struct(whole.alias("value"), (x["at"] + k + 1).alias("behind"))).otherwise(out)
        return out

    pieces = lambda p: F.array(*[number_at(data, p + k, 1) for k in range(VARINT)])
    placed = lambda p: F.struct(p.alias("at"), (F.octet_length(data) - p).alias("left"), pieces(p).alias("bytes"))
    return bound(bound(at.cast("bigint"), placed), read)


def encode(term: Column, index: Column, kind: Column, appended_ns: Column, data: Column, extensions: Column | None = None) -> Column:
    empty = F.unhex(F.lit(""))
    data, extensions = F.coalesce(data, empty), empty if extensions is None else F.coalesce(extensions, empty)
    low = lambda c, n: reversed_bytes(big_endian(c, n), n)
    length = lambda c: varint(F.octet_length(c).cast("bigint"))
    return F.concat(low(term, 8), low(index, 8), low(kind, 1), low(F.coalesce(appended_ns, F.lit(0)), 8), length(data), data, length(extensions), extensions)


def decode(envelope: Column) -> Column:
    """(term, log_index, kind, appended_ns, data, extensions); null for bytes that are no whole envelope. Empty parts are null."""
    part = lambda x: F.when(x["value"] > 0, F.substring(envelope, (x["behind"] + 1).cast("int"), x["value"].cast("int")))
    after = lambda x: x["behind"] + x["value"]

    def fields(p: Column) -> Column:
        whole = (F.octet_length(envelope) >= HEAD) & (after(p["d"]) <= F.octet_length(envelope)) & (after(p["e"]) <= F.octet_length(envelope))
        out = F.struct(
            number_at(envelope, 0, 8).alias("term"), number_at(envelope, 8, 8).alias("log_index"), number_at(envelope, 16, 1).alias("kind"), number_at(envelope, 17, 8).alias("appended_ns"),
            part(p["d"]).alias("data"), part(p["e"]).alias("extensions"),
        )
        return F.when(F.coalesce(whole, F.lit(False)), out)

    both = bound(varint_at(envelope, F.lit(HEAD)), lambda d: F.struct(d.alias("d"), varint_at(envelope, after(d)).alias("e")))
    return bound(both, fields)


def payload(envelope: Column) -> Column:
    """(is_placeholder, lsn, hlc, record): the record that a command carries, or a placeholder's lsn and hlc; null if it is no envelope."""

    def carried(e: Column) -> Column:
        is_placeholder = e["kind"] != COMMAND
        out = F.struct(
            is_placeholder.alias("is_placeholder"), F.when(is_placeholder, e["log_index"]).alias("lsn"),
            F.when(is_placeholder, F.when(e["appended_ns"] != 0, e["appended_ns"]).otherwise(1)).alias("hlc"), F.when(~is_placeholder, e["data"]).alias("record"),
        )
        return F.when(e.isNotNull(), out)

    return bound(decode(envelope), carried)


def with_lsn(record: Column, lsn: Column) -> Column:
    """A record's bytes with another lsn in place of its own; null where the record has none stored."""
    piece = lambda start, n=None: F.substring(record, start.cast("int"), F.lit(2**31 - 1) if n is None else n.cast("int"))
    written = lambda at: F.concat(piece(F.lit(1), at), reversed_bytes(big_endian(lsn, 8), 8), piece(at + 9))

    def place(p: Column) -> Column:
        entry = F.when(number_at(record, p["vtable"], 2) >= 6, number_at(record, p["vtable"] + 4, 2))
        return bound(bound(entry, lambda e: p["root"] + F.when(e > 0, e)), written)

    # the distance back to the vtable is signed
    back = lambda b: F.when(b >= 1 << 31, b - (1 << 32)).otherwise(b)
    root = bound(number_at(record, 0, 4), lambda r: F.struct(r.alias("root"), (r - bound(number_at(record, r, 4), back)).alias("vtable")))
    return bound(root, place)
