"""Scalar functions over names, sizes and lists in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Factors of size suffixes, fixed values.
SIZES = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}

#: What operations and entry types are called in change notifications, fixed values.
OPERATIONS = {"Insert": "put", "Delete": "delete", "DeleteRowByKey": "delete_row"}
ENTRY_TYPES = {"KV": "kv", "Chunked": "lob", "Row": "row"}


def lookup(value: Column, names: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.lit(None) if default is None else default)


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 16MB, in any case; what isn't one, or has a space before its unit, gives 0."""
    pattern = rf"(?i)^\s*([+-]?\d{{1,9}})({'|'.join(SIZES)})\s*$|^\s*([+-]?\d{{1,18}})\s*$"
    with_unit, unit, plain = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    factor = F.lit(1).cast("bigint")
    for name, size in SIZES.items():
        factor = F.when(F.upper(unit) == name, F.lit(size).cast("bigint")).otherwise(factor)
    number = F.when(with_unit != "", with_unit).when(plain != "", plain)
    return F.coalesce(number.cast("bigint") * factor, F.lit(0).cast("bigint"))


def split_list(text: Column, separator: str = ",") -> Column:
    """The trimmed, non-empty elements of a list."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def align8(size: Column) -> Column:
    return (F.floor((size + 7) / 8) * 8).cast("bigint")


def record_size(payload: Column) -> Column:
    """Bytes that a payload takes in a segment: its frame of 8 bytes before and 8 after, aligned to 8."""
    return align8(payload + 16)


def segment_file_name(segment: Column) -> Column:
    return F.concat(F.lpad(segment.cast("string"), 9, "0"), F.lit(".seg"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def si_count(value: Column) -> Column:
    """A count with one decimal and K, M or G from a thousand on."""
    scaled = lambda unit, name: F.concat(F.format_number(value / unit, 1), F.lit(name))
    return F.when(value >= 10**9, scaled(10**9, "G")).when(value >= 10**6, scaled(10**6, "M")).when(value >= 1000, scaled(1000, "K")).otherwise(value.cast("string"))


def method_parts(full: Column) -> Column:
    """(service, method) of /service/method."""
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    return F.struct(F.get(parts, F.lit(0)).alias("service"), F.get(parts, F.lit(1)).alias("method"))


def chunk_label(number: Column, count: Column) -> Column:
    """first, middle or last, by number from 0; a single chunk is the first."""
    return F.when(number == 0, "first").when(number == count - 1, "last").otherwise("middle")


def safe_time(nanos: Column) -> Column:
    """A time from nanoseconds; null for zero and negative ones; 64 bits end before the year 9999."""
    return F.when((nanos > 0) & (nanos < F.lit((1 << 63) - 1)), F.timestamp_micros(F.call_function("div", nanos, F.lit(1000))))


def varint_size(value: Column) -> Column:
    """Bytes that a non-negative number takes as a varint."""
    return F.greatest(F.ceil(F.length(F.regexp_replace(F.bin(value), "^0+", "")) / 7), F.lit(1)).cast("int")


def is_relative_path(path: Column) -> Column:
    """Whether a path stays below its root."""
    return ~(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | (path == ""))


def chunk_spans(size: Column, chunk: int) -> Column:
    """An array of (chunk_no, at, length) that cuts size units into chunks; empty for nothing."""
    count = F.ceil(size / chunk).cast("int")
    spans = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.alias("chunk_no"), (i * chunk).cast("bigint").alias("at"), F.least(F.lit(chunk).cast("bigint"), size - i * chunk).alias("length")),
    )
    return F.when(size > 0, spans).otherwise(F.array().cast("array<struct<chunk_no:int,at:bigint,length:bigint>>"))


#: Status codes after which a stream is tried again; after all others it ends. Words of plain messages that end it. Fixed values.
TRANSIENT = ["Unavailable", "ResourceExhausted", "DeadlineExceeded"]
PERMANENT_WORDS = ["invalid", "denied", "truncated"]


def error_kind(code: Column, message: Column) -> Column:
    """transient or permanent, by the status code, or without one by the message; no error is transient."""
    by_word = message.contains(PERMANENT_WORDS[0])
    for word in PERMANENT_WORDS[1:]:
        by_word = by_word | message.contains(word)
    by_message = F.when(F.coalesce(by_word, F.lit(False)), "permanent").otherwise("transient")
    return F.when(code.isin(*TRANSIENT), "transient").when(code.isNotNull(), "permanent").otherwise(by_message)


def metric_name(name: Column, labels: Column) -> Column:
    """A name with its labels' values behind it, spaces and colons in these replaced."""
    return F.concat_ws(".", name, F.transform(labels, lambda x: F.translate(x, " :", "__")))


def config_hash(*parts: Column) -> Column:
    """SHA-256 of a configuration's parts; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def backoff_ms(attempt: Column, first: int, most: int) -> Column:
    """Milliseconds to wait before an attempt, from 0: doubled each time up to most, then spread by 0.8 to 1.2."""
    return F.least(F.pow(F.lit(2), F.least(attempt, F.lit(40))) * first, F.lit(most)) * (F.lit(0.8) + F.rand() * 0.4)


def joined_path(*parts: Column) -> Column:
    """Parts joined by single slashes; empty parts are left out."""
    kept = F.filter(F.array(*[F.regexp_replace(p, "(?<=.)/+$", "") for p in parts]), lambda x: x != "")
    return F.regexp_replace(F.concat_ws("/", kept), "//+", "/")


def with_commas(number: Column) -> Column:
    """A whole number with commas before thousands."""
    return F.format_number(number, 0)


def time_text(at: Column) -> Column:
    """A UTC time as RFC 3339 to the second; a dash for none."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))


def decimals(value: Column, digits: int) -> Column:
    """A number with at most so many decimals and no zeros at the end; 0 for 0."""
    rounded = F.format_string(f"%.{digits}f", F.round(value, digits))
    return F.when(value == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def position_text(segment: Column, offset: Column) -> Column:
    return F.concat(F.lit("SegmentID="), segment.cast("string"), F.lit(", Offset="), offset.cast("string"))


def is_zero_position(segment: Column, offset: Column) -> Column:
    return (segment == 0) & (offset == 0)


def numbered_key(prefix: Column, worker: Column, counter: Column) -> Column:
    """prefix-worker-counter."""
    return F.concat_ws("-", prefix, worker.cast("string"), counter.cast("string"))


def positive_sizes(text: Column) -> Column:
    """The sizes of a comma-separated list; null where one isn't a positive whole number or there is none."""
    parts = split_list(text)
    sizes = F.transform(parts, lambda x: F.when(x.rlike("^[+]?[0-9]{1,18}$"), x.try_cast("bigint")))
    good = (F.size(parts) > 0) & F.forall(sizes, lambda x: F.coalesce(x > 0, F.lit(False)))
    return F.when(good, sizes)


def package_of(path: Column) -> Column:
    """The name of the folder that a file stands in, without a dot before it; unknown for none."""
    name = F.regexp_extract(path, r"([^/]+)/+[^/]*$", 1)
    return F.when((name == "") | (name == "."), "unknown").otherwise(F.regexp_replace(name, r"^\.", ""))


#: Log levels and other spellings of them, fixed values.
LEVELS = {"debug": "DEBUG", "info": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR", "": "INFO"}


def log_level(text: Column) -> Column:
    """The level that a text names, in any case; an empty one is INFO; null for others."""
    return lookup(F.lower(F.trim(text)), LEVELS)


#: Status codes of a stream's errors, fixed values; others are internal errors, which don't tell what happened.
STATUS_OF = {
    "LSN not yet available": "Unavailable",
    "LSN truncated": "OutOfRange",
    "missing required parameter: namespace": "InvalidArgument",
    "namespace is not found on the current server": "NotFound",
    "bad metadata in request": "InvalidArgument",
    "missing required metadata: x-namespace": "InvalidArgument",
    "stream timeout: no records received within dynamic threshold seconds": "Unavailable",
    "invalid sequence: StartMarker must be sent before sending chunks or calling CommitMarker": "FailedPrecondition",
    "invalid checksum: checksum mismatch": "DataLoss",
    "put chunk stream already commited": "Aborted",
}

#: HTTP statuses of the errors of writes and reads, by what went wrong; fixed values. Others give 500.
HTTP_STATUS_OF = {"committed": 409, "not_found": 404, "read_only": 403, "unsupported_type": 400, "no_columns": 400, "key_changed": 400, "aborted": 410}


def error_status(message: Column) -> Column:
    """(code, message) that a caller is told of an error."""
    code = lookup(message, STATUS_OF)
    return F.struct(F.coalesce(code, F.lit("Internal")).alias("code"), F.when(code.isNotNull(), message).otherwise("internal server error").alias("message"))


def http_status(problem: Column) -> Column:
    return lookup(problem, {k: v for k, v in HTTP_STATUS_OF.items()}, F.lit(500))


def duration_text(seconds: Column) -> Column:
    """A duration as days, hours, minutes and seconds, from the largest that isn't 0; under a minute with up to four digits."""
    whole = F.floor(F.abs(seconds)).cast("bigint")
    d, h, m, s = F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60
    part = lambda number, unit: F.concat(number.cast("bigint").cast("string"), F.lit(unit))
    long = F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), part(s, "s"))).when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))).otherwise(F.concat_ws(" ", part(m, "m"), part(s, "s")))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(whole >= 60, long).otherwise(F.concat(decimals(F.abs(seconds), 3), F.lit("s"))))
