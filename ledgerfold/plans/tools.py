"""Queries of what writes logs, codes records, reads benchmark text, makes reports and keeps tables: mostly round trips over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import envelope, keys, text
from ..operators import backup, metrics, replication, segments, state, txn, writes
from ..operators.change_feed import FeedTable, live_values
from ..session import table, work_folder
from ..sources import benchtext, log as log_source, reports, segments as segment_files, synthetic
from .general import arrival_halves
from .reference import hexed

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- writing a log --------------------------------------------------------------------------------------------------


def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two writers made one after the other: nations as pairs, regions as rows and large objects, in and outside of transactions."""
    path = work_folder(spark, "writer") / "log"
    nations = [(r.n_name.encode(), r.n_nationkey, r.n_regionkey) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    regions = [(r.r_name.encode(), r.r_regionkey) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    w = writes.LogWriter(spark, path, "n", segment_records=16)
    w.put(*[(name, b"%d" % region) for name, _, region in nations])
    w.delete(*[name for name, _, region in nations if region == 3])
    w.put_cells({name: {"id": b"%d" % key, "name": name} for name, key in regions})
    w.delete_cells({name: ["name"] for name, key in regions if key == 1})
    w.delete_rows(*[name for name, key in regions if key == 2])
    first, lost = w.begin(txn.INSERT, txn.KV), w.begin(txn.INSERT, txn.KV)
    rows, deletes = w.begin(txn.INSERT, txn.ROW), w.begin(txn.DELETE, txn.KV)
    for name, key, region in nations:
        if region == 0:
            first.put(name, b"txn")
            lost.put(name, b"lost")
        if key == 24:
            deletes.put(name, None)
    for name, key in regions:
        rows.put_cells(name, {"t": b"%d" % (key * 10)})
        w.put_object(name, name * 5, chunk=8)
    rows.commit()
    lost.abort()
    w.append()
    deletes.commit()
    first.commit()
    w.delete_objects(*[name for name, key in regions if key == 4])
    w.append()
    again = writes.LogWriter(spark, path, "n", segment_records=16)  # goes on behind the last lsn
    again.put((b"after", b"%d" % (again.lsn - w.lsn)))
    again.put_object(b"small", b"")
    again.append()
    return spark.read.schema(log_source.LOG).parquet(path)


@query
def writer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lives after the writers' records: pairs, cells, and whole objects."""
    values = state.state(written_log(spark, sf_dir))
    single = values.where("entry_type <> 'Chunked'").select("entry_type", F.hex("entry_key").alias("key_hex"), F.col("part").alias("cell_name"), F.hex("value").alias("value_hex"))
    return single.unionByName(state.objects(values).select(F.lit("Chunked").alias("entry_type"), F.hex("entry_key").alias("key_hex"), F.lit("").alias("cell_name"), F.hex("data").alias("value_hex")))


@query
def writer_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum in the commit of each large object, over its chunks in order, and the number of its chunks."""
    log = written_log(spark, sf_dir).where("entry_type = 'Chunked' AND txn_id IS NOT NULL")
    found = log.groupBy("txn_id").agg(F.max(F.when(F.col("txn_state") == "Commit", F.col("crc32_checksum"))).alias("crc"), F.count_if(F.col("txn_state") == "Prepare").alias("n_chunks"), F.max(F.when(F.col("txn_state") == "Prepare", F.get("entries", F.lit(0))["entry_key"])).alias("k"))
    return found.select(F.hex("k").alias("key_hex"), "n_chunks", (F.col("crc") == F.crc32(F.when(F.col("k") == F.lit("small").cast("binary"), F.unhex(F.lit(""))).otherwise(F.unhex(F.repeat(F.hex("k"), 5))))).alias("is_right"))


@query
def bulk_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a log as one put for each row, numbered without the driver, and the pairs that it leaves."""
    pairs = table(spark, sf_dir, "primary_kv").where("put_key IS NOT NULL")
    entry = F.struct(F.col("put_key").alias("entry_key"), F.col("put_value").alias("entry_value"), F.lit(None).cast("map<string,binary>").alias("cells"))
    folder = work_folder(spark, "bulk")
    writes.records_of(pairs, F.col("ns_name"), txn.INSERT, txn.KV, 100, entry).write.parquet(folder / "log")
    return hexed(state.kv(state.state(spark.read.schema(log_source.LOG).parquet(folder / "log"))).select("ns_name", "entry_key", "value"))


@query
def bulk_lsns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that such records get: dense from the one after the last."""
    entry = F.struct(F.col("put_key").alias("entry_key"), F.col("put_value").alias("entry_value"), F.lit(None).cast("map<string,binary>").alias("cells"))
    made = writes.records_of(table(spark, sf_dir, "primary_kv"), "main", txn.INSERT, txn.KV, 100, entry, 1000)
    return made.agg(F.count("*").alias("n"), F.count_distinct("lsn").alias("n_lsns"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.max("segment_id").alias("last_segment"))


# ---- segment files --------------------------------------------------------------------------------------------------


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's segments as files."""
    made = segment_files.to_segments(table(spark, sf_dir, "log_records"))
    return made.select(F.concat_ws("/", "ns_name", "file_name").alias("path"), "segment_id", "content")


@query
def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as segment files and read from them: every record's fields, and its entries as checksums over their bytes."""
    back = segment_files.records_of(segment_files.frames_of(files_of(spark, sf_dir)))
    parts = F.transform("entries", lambda e: F.concat_ws("=", F.hex(e["entry_key"]), F.hex(e["entry_value"]), F.array_join(F.array_sort(F.map_keys(e["cells"])), ",")))
    return back.select(
        F.element_at(F.split("path", "/"), 1).alias("ns_name"), "segment_id", "lsn", "hlc", "crc32_checksum", "operation_type", "txn_state", "entry_type", F.hex("txn_id").alias("txn_id"),
        F.hex("prev_txn_wal_index").alias("prev_position"), F.size("entries").cast("bigint").alias("n_entries"), F.md5(F.array_join(parts, ";").cast("binary")).alias("entries_md5"),
    )


@query
def segment_file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the same files."""
    h = segment_files.headers_of(files_of(spark, sf_dir))
    return h.select("path", "segment_id", "entry_count", "first_log_index", "flags", "is_valid")


@query
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the same files: aligned, in order, and as long together as the header says."""
    f = segment_files.frames_of(files_of(spark, sf_dir)).groupBy("path").agg(
        F.count("*").alias("n_frames"), F.min("seg_offset").alias("first_offset"), F.count_if(F.col("seg_offset") % 8 != 0).alias("n_unaligned"), F.sum(text.record_size(F.octet_length("data").cast("bigint"))).alias("n_bytes")
    )
    h = segment_files.headers_of(files_of(spark, sf_dir)).select("path", "write_offset")
    return f.join(h, "path").select("path", "n_frames", "first_offset", "n_unaligned", (F.col("write_offset") == F.col("n_bytes") + 64).alias("is_full"))


@query
def log_from_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from LSN 4000 on, and from 0, the beginning, by namespace."""
    log = segments.distinct_records(table(spark, sf_dir, "log_records"))
    count = lambda lsn, name: segments.from_lsn(log, lsn).groupBy("ns_name").agg(F.count("*").alias(name))
    return count(0, "n_all").join(count(4000, "n_from"), "ns_name", "left")


@query
def log_without_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a delete of LSNs 1000 to 3000, of which none after 2500 may go."""
    log = segments.distinct_records(table(spark, sf_dir, "log_records"))
    return segments.without_range(log, 1000, 3000, 2500).groupBy("ns_name").agg(F.count("*").alias("n"), F.sum("lsn").alias("sum_lsn"))


@query
def txn_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed transactions and whether their chain of records is whole."""
    return hexed(txn.chains(table(spark, sf_dir, "log_records")))


@query
def log_object_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live large objects and whether all of their chunks are there."""
    return hexed(state.object_checks(table(spark, sf_dir, "log_records")))


@query
def position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the record before each record of a transaction stands where its position says, by status."""
    log = table(spark, sf_dir, "log_records").where("prev_txn_wal_index IS NOT NULL")
    p = keys.decode_position(F.col("prev_txn_wal_index"))
    claimed = log.select("ns_name", (F.col("lsn") - 1).alias("lsn"), p["segment_id"].alias("segment_id"), p["seg_offset"].alias("seg_offset")).distinct()
    return replication.position_checks(claimed, table(spark, sf_dir, "log_records")).groupBy("ns_name", "status").agg(F.count("*").alias("n"))


@query
def relay_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the order of their delivery: breaks in the sequence of LSNs, and delays behind the first consumer."""
    return replication.relay_checks(table(spark, sf_dir, "stream_batches"))


@query
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers as servers: those with a finished run are voters, the one that saw the highest LSN leads."""
    own = table(spark, sf_dir, "stream_requests").groupBy("consumer_id").agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.max("latest_lsn").alias("top"))
    heads = own.agg(F.max("top").alias("head"))
    return replication.cluster_stats(own.join(F.broadcast(heads)), F.col("n_ok") > 0, F.col("top") == F.col("head"))


@query
def namespace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers that follow a namespace, each once."""
    lists = table(spark, sf_dir, "stream_requests").groupBy("consumer_id").agg(F.collect_set("ns_name").alias("names"))
    return replication.members(lists, "consumer_id", "names", "billing").select("consumer_id")


# ---- backups, upkeep ------------------------------------------------------------------------------------------------


@query
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of the live state and of the sealed segments' headers: what a dry run tells, then what a restoration does."""
    folder = work_folder(spark, "backup")
    b = backup.Backup(spark, folder / "backup")
    b.write({"state": live_values(state.state(table(spark, sf_dir, "log_records"))), "segments": segments.backup_after(table(spark, sf_dir, "segment_headers"), 0)})
    told = b.restore(folder / "target", dry_run=True)
    done = b.restore(folder / "target")
    return told.unionByName(done).select("part", "action", "n_rows")


@query
def restored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live state as it is read after a restoration."""
    folder = work_folder(spark, "backup")
    b = backup.Backup(spark, folder / "backup")
    b.write({"state": live_values(state.state(table(spark, sf_dir, "log_records")))})
    b.restore(folder / "target", ["state"])
    return backup.restored(spark, folder / "target", "state")


@query
def feed_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a change feed whose first epoch was folded, and whose second was folded alone, read after both."""
    feed = FeedTable(spark, work_folder(spark, "feed").path)
    for i, batch in enumerate(arrival_halves(table(spark, sf_dir, "log_records"))):
        feed.apply(batch)
        feed.compact(None if i == 0 else 1)
        feed.vacuum()
    return live_values(feed.read())


@query
def feed_abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared entries that still wait after all open transactions of one namespace were abandoned, by namespace and type."""
    log = table(spark, sf_dir, "log_records")
    feed = FeedTable(spark, work_folder(spark, "feed").path)
    feed.apply(log)
    feed.abandon(log.where("ns_name = 'main' AND txn_id IS NOT NULL").select("ns_name", "txn_id"))
    waits = feed.read_held("waiting", feed.manifest()).select("ns_name", "entry_type", "lsn", "entry_no").distinct()
    return waits.groupBy("ns_name", "entry_type").agg(F.count("*").alias("n"))


# ---- codes ----------------------------------------------------------------------------------------------------------


@query
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed records put into envelopes of a consensus log, every third as a placeholder, and read from them."""
    r = table(spark, sf_dir, "stream_batches").select("batch_id", F.posexplode("records").alias("pos", "r")).where("r.lsn IS NOT NULL")
    made = envelope.encode(F.lit(7), F.col("r.lsn"), F.when(F.col("r.lsn") % 3 == 0, 1).otherwise(0), F.col("batch_id") * 1000, F.col("r.record"), F.lit("x").cast("binary"))
    back = r.select("batch_id", F.col("pos").cast("bigint").alias("pos"), made.alias("m")).select("batch_id", "pos", envelope.payload(F.col("m")).alias("p"), envelope.decode(F.col("m")).alias("e"))
    return back.select("batch_id", "pos", "e.term", "e.log_index", "p.is_placeholder", "p.lsn", "p.hlc", F.md5(F.coalesce("p.record", F.unhex(F.lit("")))).alias("md5"))


@query
def renumbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's records in their binary form with another LSN written into the bytes, and read again; all else stays."""
    f = segment_files.frames_of(files_of(spark, sf_dir))
    moved = f.withColumn("data", envelope.with_lsn(F.col("data"), F.col("seg_offset") + 1_000_000))
    back = segment_files.records_of(moved)
    return back.groupBy(F.element_at(F.split("path", "/"), 1).alias("ns_name"), "operation_type", "entry_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("lsn") == F.col("seg_offset") + 1_000_000).alias("n_renumbered"), F.sum(F.size("entries").cast("bigint")).alias("n_entries")
    )


@query
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each namespace's last record as a checkpoint's bytes, whole and without the consensus' part, and read from them."""
    last = table(spark, sf_dir, "log_records").groupBy("ns_name").agg(F.max_by(F.struct("segment_id", "seg_offset"), "lsn").alias("p"), F.max("lsn").alias("n"))
    data = keys.encode_checkpoint(F.col("n"), F.col("p.segment_id"), F.col("p.seg_offset"), F.col("n") + 5, F.lit(3))
    short = keys.decode_checkpoint(F.substring(data, 1, 20))
    return last.select("ns_name", keys.decode_checkpoint(data).alias("c"), short["raft_index"].alias("short_index"), (short["records"] == F.col("n")).alias("same"), F.octet_length(data).cast("bigint").alias("size")).select("ns_name", "c.*", "short_index", "same", "size")


@query
def record_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the log as 12 bytes, as text, and whether it is zero."""
    at = table(spark, sf_dir, "log_records").select("segment_id", "seg_offset").distinct()
    seg, off = F.col("segment_id"), F.col("seg_offset")
    return at.select("segment_id", "seg_offset", F.hex(keys.encode_position(seg, off)).alias("position_hex"), text.position_text(seg, off).alias("position"), text.is_zero_position(seg, off).alias("is_zero"))


@query
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed keys as a store makes them, of plain keys and of keys that are typed already."""
    k = table(spark, sf_dir, "put_requests").where("put_key IS NOT NULL").select("put_key").distinct()
    c, cell = F.col("put_key"), F.lit("c1")
    return k.select(
        F.hex(c).alias("key_hex"), F.hex(keys.stored_cell_key(c, cell)).alias("cell_hex"), (keys.stored_cell_key(keys.row_key(c), cell) == keys.cell_key(c, cell)).alias("typed_row_stays"),
        F.hex(keys.stored_chunk_key(c, F.lit(2))).alias("chunk_hex"), (keys.stored_chunk_key(keys.chunk_key(c, F.lit(0)), F.lit(0)) == keys.chunk_key(c, F.lit(0))).alias("typed_chunk_stays"),
        (keys.kv_key(keys.kv_key(c)) == keys.kv_key(c)).alias("typed_kv_stays"), F.hex(keys.system_key(F.lit("wal.checkpoint"))).alias("system_hex"), keys.kind_of(keys.system_key(F.lit("x"))).alias("system_kind"),
    )


# ---- names, sizes, texts --------------------------------------------------------------------------------------------


@query
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written and read: of each part a text such as 11MB, a list of sizes, clamped and short numbers."""
    p = table(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KB", "mb", "GB", " KB", "")]), (n % 5 + 1).cast("int"))
    return p.select(
        "p_partkey", text.parse_size(F.concat(size, unit)).alias("bytes"), F.size(text.split_list(F.concat(size, F.lit(", ,a ,b,")))).cast("bigint").alias("n_list"),
        F.coalesce(F.aggregate(text.positive_sizes(F.concat(size, F.lit(" , "), n.cast("string"))), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(-1).cast("bigint")).alias("sum_sizes"),
        text.clamp(n - 50, 0, 100).alias("clamped"), text.si_count(n * n * n).alias("si"), text.with_commas(n * 12345).alias("commas"), text.decimals(F.col("p_retailprice") / 7, 2).alias("latency"),
        text.align8(n).alias("aligned"), text.varint_size(n * n).cast("bigint").alias("varint"),
    )


@query
def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names taken apart and put together, with customers' names as material."""
    c = table(spark, sf_dir, "customer")
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    method = text.method_parts(F.concat(F.lit("/"), seg, F.lit("/"), name))
    return c.select(
        "c_custkey", method["service"].alias("service"), method["method"].alias("method"), text.segment_file_name(k).alias("file_name"), text.numbered_key(seg, F.col("c_nationkey"), k).alias("bench_key"),
        text.package_of(F.concat(F.lit("/app/"), seg, F.lit("/"), name, F.lit(".go"))).alias("package"), text.package_of(name).alias("no_package"), text.metric_name(F.lit("m"), F.array(seg, F.lit("a b:c"))).alias("metric"),
        text.joined_path(F.lit("root/"), seg, F.lit(""), name).alias("path"), text.is_relative_path(F.concat(F.when(k % 3 == 0, "/").when(k % 3 == 1, "../").otherwise("a/"), name)).alias("is_relative"),
        text.config_hash(name, F.lit(None).cast("string"), seg).alias("hash"), text.chunk_label(k % 4, F.lit(4)).alias("label"), text.log_level(F.element_at(F.array(*[F.lit(x) for x in ("Debug", " warning ", "", "loud")]), (k % 4 + 1).cast("int"))).alias("level"),
    )


@query
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and durations as text, from the events."""
    e = table(spark, sf_dir, "events")
    at, ns = F.col("ts").cast("timestamp"), F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    seconds = F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 37).otherwise(F.col("event_id") % 60)
    return e.select(
        "event_id", text.time_text(at).alias("at"), text.time_text(F.lit(None).cast("timestamp")).alias("none"), F.unix_millis(at).alias("hlc"),
        F.unix_micros(text.safe_time(F.when(F.col("event_id") % 3 > 0, ns).otherwise(0))).alias("safe_us"), text.duration_text(seconds.cast("double")).alias("duration"),
    )


@query
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each known error, and some unknown ones: its kind, status code, what a caller is told, and HTTP statuses."""
    known = [*text.STATUS_OF, "boom", "permission denied"]
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % len(known)).cast("int").alias("i")).distinct()
    message = F.get(F.array(*[F.lit(m) for m in known]), F.col("i"))
    problem = F.get(F.array(*[F.lit(m) for m in [*text.HTTP_STATUS_OF, "other"]]), F.col("i"))
    status = text.error_status(message)
    return rows.select(
        message.alias("error"), status["code"].alias("code"), status["message"].alias("told"), text.error_kind(F.when(status["code"] != "Internal", status["code"]), message).alias("kind"), problem.alias("problem"),
        text.http_status(problem).cast("bigint").alias("http"),
    )


@query
def backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times before attempts are within a fifth of what they should be."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 12).alias("attempt"))
    ms = text.backoff_ms(F.col("attempt"), 100, 10_000)
    base = F.least(F.pow(F.lit(2), F.col("attempt")) * 100, F.lit(10_000.0))
    return e.select("attempt", ms.alias("ms"), base.alias("base")).groupBy("attempt").agg(F.count("*").alias("n"), F.bool_and((F.col("ms") >= F.col("base") * 0.8) & (F.col("ms") <= F.col("base") * 1.2)).alias("is_within"))


# ---- metrics --------------------------------------------------------------------------------------------------------


@query
def sampled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines by level, all errors and no debug lines kept; lines of no level are left out."""
    level = text.lookup(F.col("event_type"), {"error": "ERROR", "click": "debug", "view": "warn"}, F.lit("trace"))
    kept = metrics.sampled_levels(table(spark, sf_dir, "events"), level, {"debug": 0, "Info": 0})
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query
def slow_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events slower than 50, by type."""
    return metrics.slower_than(table(spark, sf_dir, "events"), "value", 50).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def io_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of the quantity that waits, as the share of one counter of several."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("wait"), F.col("l_quantity").alias("busy"))
    return metrics.share(rows, "wait", ["wait", "busy"]).select(F.round("percent", 6).alias("percent"))


# ---- benchmark text -------------------------------------------------------------------------------------------------


def lines(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select(line.alias("value"))


@query
def bench_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load generator's CSV, written from the events and read; lines without numbers are left out."""
    folder = work_folder(spark, "csv")
    e = table(spark, sf_dir, "events")
    e.select(F.col("event_type").alias("test"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("rps"), F.col("value").alias("p50_latency_ms")).write.option("header", True).csv(folder / "c")
    return benchtext.load_csv(spark, folder / "c").groupBy("test").agg(F.count("*").alias("n"), F.sum("rps").cast("bigint").alias("rps"), F.round(F.sum("p50_ms"), 4).alias("p50_ms"))


def gc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clock = F.when(F.col("event_id") % 5 == 0, F.format_string("%.1f+%.1f", "value", F.lit(2.0))).otherwise(F.format_string("%.1f+%.1f+%.1f", "value", F.lit(3.0), F.lit(0.5)))
    line = F.concat(F.lit("gc "), F.col("event_id").cast("string"), F.lit(" @"), (F.col("event_id") / 10).cast("decimal(20,1)").cast("string"), F.lit("s 2%: "), clock, F.lit(" ms clock, 1+2 ms cpu, 4->5->"), F.col("user_id").cast("string"), F.lit(" MB, 9 MB goal, 8 P"))
    return lines(e, F.when(F.col("event_id") % 11 == 0, "another line").otherwise(line))


@query
def gc_trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a garbage collector's trace, of both forms."""
    found = benchtext.gc_lines(gc_text(spark, sf_dir))
    return found.select("cycle", F.round("at_s", 1).alias("at_s"), F.round("pause_ms", 1).alias("pause_ms"), F.round("concurrent_ms", 1).alias("concurrent_ms"), "heap_before", "heap_after", "goal_mb")


@query
def gc_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchtext.gc_summary(benchtext.gc_lines(gc_text(spark, sf_dir)))
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("span_s", "mean_ms", "p95_ms")])


@query
def bench_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines, with and without a rate."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("BenchmarkPut/"), F.translate("p_name", " ", "_"), F.lit("-8   \t"), (F.col("p_partkey") + 1).cast("string"), F.lit("\t"), F.col("p_size").cast("string"), F.lit(".5 ns/op"), F.when(F.col("p_partkey") % 2 == 0, "\t  12.25 MB/s").otherwise(""))
    return benchtext.bench_lines(lines(p, line)).groupBy("name").agg(F.sum("n").alias("n"), F.sum("ns_per_op").alias("ns_per_op"), F.sum("mb_per_s").alias("mb_per_s"))


@query
def relayer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in blocks, each sample under its heading: nations by region."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("at"), F.concat(F.lit("SET: "), F.col("n_name"), F.lit(" requests per second")).alias("value"))
    heads = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(-1).alias("at"), F.concat(F.lit("relayers: "), F.col("r_name")).alias("value"))
    log = n.unionByName(heads).withColumn("no", F.col("n_regionkey") * 1000 + F.col("at"))
    return benchtext.blocks(log, "no", r"^relayers: (.+)", r"^SET: (\S+) requests")


@query
def load_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of samples by number of relayers and operation."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("relayers"), F.col("event_type").alias("op"), F.col("event_id").cast("double").alias("rps"), F.col("value").alias("latency_ms"))
    return benchtext.load_by_size(e).select("relayers", "op", F.round("rps", 4).alias("rps"), F.round("latency_ms", 4).alias("latency_ms"))


@query
def chunk_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a segment benchmark's times by mode, for chunks up to 16 KB and above."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("BenchmarkSegment/"), F.element_at(F.split("p_name", " "), 1), F.lit("/segment_16MB/chunk_"), F.col("p_size").cast("string"), F.lit("KB/"), F.lower("p_type"), F.lit("-8  100  "), (F.col("p_partkey") * 1000).cast("string"), F.lit(" ns/op"))
    return benchtext.chunk_summary(benchtext.chunk_lines(lines(p, line))).select("mode", "is_small", F.round("mean_ms", 6).alias("mean_ms"))


# ---- made keys and values -------------------------------------------------------------------------------------------


@query
def made_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of keys and values: how many, within their bounds, and about as many small values as asked for."""
    k = synthetic.keys(spark, 500).agg(F.lit("keys").alias("pool"), F.count("*").alias("n"), F.bool_and(F.octet_length("key").between(5, 256)).alias("is_right"))
    size = F.octet_length("value")
    v = synthetic.values(spark, 2000).agg(F.lit("values").alias("pool"), F.count("*").alias("n"), (F.bool_and(size.between(100, 102_400)) & F.avg((size <= 2048).cast("int")).between(0.87, 0.93)).alias("is_right"))
    p = synthetic.picks(spark, 3000, 40).agg(F.lit("picks").alias("pool"), F.count("*").alias("n"), (F.count_distinct("key_no") == 40).alias("is_right"))
    old = synthetic.keys(spark, 500)
    changed = synthetic.mutated(old, 1).join(old.withColumnRenamed("key", "was"), "key_no")
    m = changed.agg(F.lit("mutated").alias("pool"), F.count("*").alias("n"), F.avg((F.col("key") != F.col("was")).cast("int")).between(0.05, 0.15).alias("is_right"))
    o = synthetic.operations(spark, 10_000, {"put": 6, "get": 3, "delete": 1}).groupBy("op").agg(F.count("*").alias("c"))
    o = o.agg(F.lit("operations").alias("pool"), F.sum("c").alias("n"), F.bool_and(F.abs(F.col("c") / 1000 - text.lookup(F.col("op"), {"put": 6, "get": 3, "delete": 1})) < 0.5).alias("is_right"))
    return k.unionByName(v).unionByName(p).unionByName(m).unionByName(o)


# ---- reports --------------------------------------------------------------------------------------------------------


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = segments.current_headers(table(spark, sf_dir, "segment_headers"))
    return h.withColumn("status", F.when(segments.is_sealed(F.col("flags")), "sealed").otherwise("active"))


@query
def report_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of one namespace's segments as a text table."""
    return reports.segment_list(listed(spark, sf_dir).where("ns_name = 'main'"), ["segment_id"])


@query
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One namespace's totals as labelled lines."""
    t = segments.totals(table(spark, sf_dir, "segment_headers")).where("ns_name = 'main'")
    c = F.col
    return reports.labelled(t, {"Total Segments": c("n_segments"), "  Sealed": c("n_sealed"), "  Active": c("n_active"), "Total Entries": text.with_commas(c("n_entries")), "Total Size": text.with_commas(c("n_bytes"))})


@query
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of operations as CSV, with a header."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total_ops"), F.max("value").alias("most"), F.lit('a "b", c').alias("note"))
    return reports.csv_lines(s, ["event_type", "note", "most", "total_ops"], header=True)


@query
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of segments as JSON lines."""
    return reports.json_lines(listed(spark, sf_dir).select("ns_name", "segment_id", "status", "entry_count"))


@query
def namespaces_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All namespaces in order, as one list."""
    names = table(spark, sf_dir, "log_records").select("ns_name").distinct()
    return names.agg(F.array_join(F.array_sort(F.collect_list("ns_name")), ",").alias("namespaces"))
