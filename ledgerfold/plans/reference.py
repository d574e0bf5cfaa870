"""Queries of the log engine's own operators: state, transactions, segments, replication, metrics and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import checksums, keys, text
from ..operators import crdt, metrics, replication, segments, snapshot, state, txn
from ..session import ship, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def hexed(df: DataFrame) -> DataFrame:
    """Binary columns as hexadecimal digits, so that results are text and numbers only."""
    return df.select(*[F.hex(c).alias(c) if kind == "binary" else F.col(c) for c, kind in df.dtypes])


# ---- state, from the log ------------------------------------------------------------------------------------------


@query
def log_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live KV pairs and the order key of their last write."""
    return hexed(state.kv(state.state(table(spark, sf_dir, "log_records"))))


@query
def log_row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live cells of rows, one row of the result for each."""
    return hexed(state.row_cells(state.state(table(spark, sf_dir, "log_records"))))


@query
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each live row with the number of its cells and their names in order."""
    rows = state.rows(state.state(table(spark, sf_dir, "log_records")))
    names = F.array_sort(F.map_keys("cells"))
    return rows.select("ns_name", F.hex("entry_key").alias("entry_key"), F.size("cells").cast("bigint").alias("n_cells"), F.array_join(names, ",").alias("cell_names"))


@query
def log_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by key with two of its columns named, the others left out: the filters reach the scan of the log."""
    values = state.state(table(spark, sf_dir, "log_records")).where((F.col("ns_name") == "main") & (F.col("entry_key") == F.lit("row:session-board").cast("binary")))
    return hexed(state.row_cells(values).where(F.col("cell_name") < "f_m").select("cell_name", "value", "lsn"))


@query
def log_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large objects put together: chunks, bytes, MD5 of the whole."""
    found = state.objects(state.state(table(spark, sf_dir, "log_records")))
    return found.select("ns_name", F.hex("entry_key").alias("entry_key"), F.col("n_chunks").cast("bigint").alias("n_chunks"), F.octet_length("data").cast("bigint").alias("n_bytes"), F.md5("data").alias("md5"))


@query
def log_object_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large objects in pieces, each chunk with its number and label."""
    found = state.chunks(state.state(table(spark, sf_dir, "log_records")))
    sizes = found.select("ns_name", "entry_key", "chunk_no", F.octet_length("value").cast("bigint").alias("n_bytes"))
    counts = sizes.groupBy("ns_name", "entry_key").agg(F.count("*").alias("n"))
    out = sizes.join(counts, ["ns_name", "entry_key"])
    return out.select("ns_name", F.hex("entry_key").alias("entry_key"), "chunk_no", "n_bytes", text.chunk_label(F.col("chunk_no"), F.col("n")).alias("label"))


@query
def log_three_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that live in more than one view at once; the views are independent."""
    values = state.state(table(spark, sf_dir, "log_records"))
    kinds = F.array_join(F.array_sort(F.collect_set("entry_type")), ",").alias("entry_types")
    return values.groupBy("ns_name", F.hex("entry_key").alias("entry_key")).agg(kinds).where(F.col("entry_types").contains(","))


@query
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event entries, which leave no state."""
    return hexed(state.events(table(spark, sf_dir, "log_records")))


@query
def log_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change messages to send for each effective entry, counted by topic and operation."""
    sent = replication.notifications(txn.effective(table(spark, sf_dir, "log_records")).where("entry_key IS NOT NULL"), F.col("entry_key"))
    op = F.get_json_object("message", "$.operation")
    distinct = sent.distinct()
    return distinct.groupBy("topic", op.alias("operation")).agg(F.count("*").alias("n"), F.max(F.get_json_object("message", "$.seq_num").cast("bigint")).alias("last_seq"))


@query
def log_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery: a snapshot at LSN 5000 with the rest of the log replayed onto it."""
    log = table(spark, sf_dir, "log_records")
    back = snapshot.recover(snapshot.snapshot_changes(log, 5000), snapshot.tail_changes(log, 5000))
    return back.groupBy("ns_name", "entry_type").agg(F.count("*").alias("n_values"), F.sum("lsn").alias("sum_lsn"), F.sum("entry_no").alias("sum_entry_no"))


# ---- transactions -------------------------------------------------------------------------------------------------


@query
def log_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hexed(replication.transactions(table(spark, sf_dir, "log_records")))


@query
def log_txn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions by namespace and status, with their prepared records and the time from begin to end."""
    t = replication.transactions(table(spark, sf_dir, "log_records"))
    return t.groupBy("ns_name", "status").agg(F.count("*").alias("n"), F.sum("n_prepared").alias("n_prepared"), F.sum(F.col("last_ms") - F.col("first_ms")).alias("sum_ms"))


@query
def log_stale_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open transactions that a reaper would abort at the log's last time."""
    log = table(spark, sf_dir, "log_records").withColumn("hlc", hlc_ms())
    now = log.groupBy("ns_name").agg(F.max("hlc").alias("now_ms"))
    t = replication.transactions(log).join(now, "ns_name")
    return hexed(replication.stale(t, F.col("now_ms")).select("ns_name", "txn_id", "n_prepared", "first_lsn"))


@query
def log_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared entries that no commit makes visible."""
    log = table(spark, sf_dir, "log_records")
    lost = txn.invisible(txn.prepared(txn.entries(log)), txn.commits(log)).select("ns_name", "entry_type", "lsn", "entry_no").distinct()
    return lost.groupBy("ns_name", "entry_type").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"))


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as prepared entries of their orders' transactions, and the commits: those of orders with status F."""
    lines = table(spark, sf_dir, "lineitem").select(F.lit("orders").alias("ns_name"), F.lit(1).alias("lsn"), F.lit("Insert").alias("operation_type"), F.col("l_orderkey").alias("txn_id"), "l_quantity")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("orders").alias("ns_name"), F.col("o_orderkey").alias("txn_id"), F.lit(2).alias("commit_lsn"), F.lit("Insert").alias("commit_op"))
    return lines, done


def line_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("txn_id").alias("l_orderkey")).agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query
def txn_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, F being committed, and their lines as prepared entries."""
    return line_sums(txn.visible(*order_lines(spark, sf_dir)))


@query
def txn_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_sums(txn.invisible(*order_lines(spark, sf_dir)))


@query
def txn_commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the order of o_orderkey, committed in that of (o_orderdate, o_orderkey): the last commit counts."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return state.latest(done, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


# ---- folds of the events table ------------------------------------------------------------------------------------


@query
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return state.latest(events, ["user_id"], ["event_id"], ["event_id", "event_type", "value"], F.col("event_type") == "error")


@query
def kv_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.versions(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup deletes the row, error deletes the cell click, all others write the cell of their type."""
    events = table(spark, sf_dir, "events")
    cells = events.where("event_type <> 'signup'").select(
        "user_id", F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")).alias("cell_name"),
        "event_id", "value", (F.col("event_type") == "error").alias("removed"),
    )
    bars = events.where("event_type = 'signup'").select("user_id", "event_id")
    return state.fold_cells(cells, bars, ["user_id"], "cell_name", ["event_id"], F.col("removed"), ["value"])


@query
def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir)


@query
def row_columns_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two columns named."""
    cells = event_cells(spark, sf_dir).select(F.lit("Row").alias("entry_type"), F.lit("events").alias("ns_name"), F.col("user_id").alias("entry_key"), F.col("cell_name").alias("part"), "value", F.lit(0).alias("commit_lsn"), F.col("event_id").alias("lsn"), F.lit(0).alias("entry_no"))
    return state.row_cells(cells, ["view", "purchase"]).select(F.col("entry_key").alias("user_id"), "cell_name", F.col("lsn").alias("event_id"), "value")


@query
def barrier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event deletes their row."""
    events = table(spark, sf_dir, "events")
    return state.latest(events, ["user_id"], ["event_id"], ["event_id"], F.col("event_type") != "signup")


@query
def multi_ns_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user that is a customer, with the customer's segment."""
    events = state.latest(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type", "value"])
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return events.join(customers, "user_id")


@query
def recover_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of a snapshot up to the middle of the log and of what came after."""
    events = table(spark, sf_dir, "events")
    middle = events.agg((F.max("event_id") / 2).cast("bigint").alias("middle"))
    marked = events.join(F.broadcast(middle), F.lit(True))  # one row
    carry = ["event_type", "value"]
    snap = state.latest(marked.where("event_id <= middle"), ["user_id"], ["event_id"], ["event_id", *carry])
    tail = marked.where("event_id > middle").select("user_id", "event_id", *carry)
    return state.latest(snap.unionByName(tail), ["user_id"], ["event_id"], ["event_id", *carry])


# ---- segments -----------------------------------------------------------------------------------------------------


@query
def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_stats(table(spark, sf_dir, "log_records"))


@query
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current header of each segment, its file name and status."""
    h = segments.current_headers(table(spark, sf_dir, "segment_headers"))
    status = F.when(segments.is_sealed(F.col("flags")), "Sealed").otherwise("Active")
    return h.select("ns_name", "segment_id", text.segment_file_name(F.col("segment_id")).alias("file_name"), status.alias("status"), "entry_count", "write_offset", "first_log_index")


@query
def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.totals(table(spark, sf_dir, "segment_headers"))


@query
def segment_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed segments beyond the newest five of a namespace."""
    return segments.retention(table(spark, sf_dir, "segment_headers"), 5)


@query
def segment_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same behind a checkpoint, which stands where half of the namespace's records are."""
    log = table(spark, sf_dir, "log_records")
    marks = log.groupBy("ns_name").agg(F.floor((F.min("segment_id") + F.max("segment_id")) / 2).alias("checkpoint_segment"))
    return segments.retention(table(spark, sf_dir, "segment_headers"), 5, marks)


@query
def segment_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed segments after number 40, as a backup copies them, and the newest sealed one of each namespace."""
    h = table(spark, sf_dir, "segment_headers")
    newest = segments.last_sealed(h).withColumn("is_last", F.lit(True))
    return segments.backup_after(h, 40).join(newest, ["ns_name", "segment_id"], "left").select("ns_name", "segment_id", "entry_count", F.coalesce("is_last", F.lit(False)).alias("is_last"))


@query
def segment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose header doesn't agree with the records the log holds of them."""
    h = segments.current_headers(table(spark, sf_dir, "segment_headers")).select("ns_name", "segment_id", "entry_count", "first_log_index")
    s = segments.segment_stats(table(spark, sf_dir, "log_records"))
    both = h.join(s, ["ns_name", "segment_id"], "full_outer")
    bad = ~F.col("entry_count").eqNullSafe(F.col("n_records")) | ~F.col("first_log_index").eqNullSafe(F.col("first_lsn"))
    return both.where(bad).select("ns_name", "segment_id", "entry_count", "n_records", "first_log_index", "first_lsn")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of segments of 1,000 records."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("ns_name"), F.col("event_id").alias("lsn"), F.expr("event_id div 1000 + 1").alias("segment_id"), (F.col("event_id") % 1000 * 64).alias("seg_offset"))


@query
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_stats(event_log(spark, sf_dir)).select("segment_id", "n_records", "first_lsn", "last_lsn")


@query
def retention_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four oldest segments of events, by a retention that keeps all but four."""
    stats = segments.segment_stats(event_log(spark, sf_dir))
    headers = stats.select("ns_name", "segment_id", F.lit(None).cast("timestamp").alias("last_modified_at"), F.col("n_records").alias("entry_count"), F.lit(0).alias("write_offset"), F.lit(segments.SEALED).cast("bigint").alias("flags"))
    keep = max(stats.count() - 4, 0)
    gone = segments.retention(headers, keep, least=0)
    return stats.join(gone, ["ns_name", "segment_id"], "left_semi").select("segment_id", "n_records")


# ---- continuity, positions, scans ---------------------------------------------------------------------------------


@query
def log_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.bounds(table(spark, sf_dir, "log_records"))


@query
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of LSNs that are missing once the placeholders are taken out of the log, so that there are some."""
    return segments.gaps(table(spark, sf_dir, "log_records").where("operation_type <> 'RaftInternal'"))


@query
def lsn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of events without those of type view."""
    events = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.lit("events").alias("ns_name"), "event_id")
    return segments.gaps(events, seq="event_id")


@query
def log_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at or after a position: segment 40, offset 512."""
    found = segments.from_position(table(spark, sf_dir, "log_records"), 40, 512)
    return found.select("ns_name", "segment_id", "seg_offset", "lsn").distinct()


@query
def log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with 2100 < lsn <= 2200, and the 8-byte keys under which an object store holds them."""
    found = replication.in_range(table(spark, sf_dir, "log_records"), 2100, 2200).select("ns_name", "lsn").distinct()
    key = keys.lsn_key(F.col("lsn"))
    return found.select("ns_name", "lsn", F.hex(key).alias("key_hex"), keys.lsn_of(key).alias("decoded"))


@query
def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the transactions' previous records stand: the encoded position, decoded and looked up in the index."""
    log = table(spark, sf_dir, "log_records")
    index = segments.positions(log).select("ns_name", F.col("lsn").alias("prev_lsn"), "segment_id", "seg_offset")
    p = keys.decode_position(F.col("prev_txn_wal_index"))
    chained = log.where("prev_txn_wal_index IS NOT NULL").select("ns_name", "lsn", p["segment_id"].alias("segment_id"), p["seg_offset"].alias("seg_offset")).distinct()
    return chained.join(index, ["ns_name", "segment_id", "seg_offset"]).select("ns_name", "lsn", "prev_lsn")


@query
def log_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records up to a commit boundary, by namespace, and those that a truncation after LSN 3000 leaves."""
    log = segments.distinct_records(table(spark, sf_dir, "log_records"), "segment_id", "seg_offset")
    a = segments.committed(log, 45, 1024).groupBy("ns_name").agg(F.count("*").alias("n_committed"))
    b = segments.truncate(log, 3000).groupBy("ns_name").agg(F.count("*").alias("n_kept"))
    return a.join(b, "ns_name", "full_outer")


@query
def log_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records at one position of their logs."""
    return segments.at_position(table(spark, sf_dir, "log_records"), 40, 64).select("ns_name", "lsn").distinct()


@query
def log_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the log still, or already, holds what followers ask for."""
    wanted = table(spark, sf_dir, "stream_requests").where("start_lsn IS NOT NULL").select("consumer_id", "ns_name", F.col("start_lsn").alias("lsn")).distinct()
    return segments.availability(wanted, table(spark, sf_dir, "log_records"))


@query
def log_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a new leader's ten records from the middle of each namespace on."""
    log = segments.distinct_records(table(spark, sf_dir, "log_records"), "operation_type").withColumn("is_new", F.lit(False))
    middle = log.groupBy("ns_name").agg(F.floor((F.min("lsn") + F.max("lsn")) / 2).alias("mid"))
    batch = log.join(middle, "ns_name").where(F.col("lsn").between(F.col("mid"), F.col("mid") + 9))
    batch = batch.select("ns_name", "lsn", F.lit("NoOperation").alias("operation_type"), F.lit(True).alias("is_new"))
    return segments.stored(log, batch).groupBy("ns_name").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"), F.max("lsn").alias("last_lsn"))


# ---- replication --------------------------------------------------------------------------------------------------


@query
def replica_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each namespace's follower, 100 records into the log, may apply of a log that lost its placeholders."""
    log = table(spark, sf_dir, "log_records")
    followers = segments.bounds(log).select("ns_name", (F.col("first_lsn") + 100).alias("last_lsn"))
    return replication.applicable(log.where("operation_type <> 'RaftInternal'"), followers)


@query
def replica_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's last event is behind the last of all, whose one row is broadcast."""
    events = table(spark, sf_dir, "events")
    heads = events.select(F.lit(1).alias("one"), "event_id").groupBy("one").agg(F.max("event_id").alias("head"))
    own = events.groupBy("user_id").agg(F.max("event_id").alias("last_id")).withColumn("one", F.lit(1))
    return metrics.lag(F.broadcast(heads), own, ["one"], "head", "last_id", 100).select("user_id", "last_id", "lag", "is_behind")


@query
def follower_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each follower's last finished request is behind the head of its log."""
    heads = segments.bounds(table(spark, sf_dir, "log_records")).select("ns_name", F.col("last_lsn").alias("head"))
    done = table(spark, sf_dir, "stream_requests").groupBy("consumer_id", "ns_name").agg(F.max(F.when(F.col("outcome") == "ok", F.col("latest_lsn"))).alias("at_lsn"))
    return metrics.lag(heads, done, ["ns_name"], "head", "at_lsn", 500).select("consumer_id", "ns_name", "at_lsn", "lag", "is_behind")


@query
def stream_batches_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per consumer and namespace: batches, records, bytes, damaged records, the last LSN."""
    r = table(spark, sf_dir, "stream_batches").select("consumer_id", "ns_name", "batch_id", F.explode_outer("records").alias("r"))
    return r.groupBy("consumer_id", "ns_name").agg(
        F.count_distinct("batch_id").alias("n_batches"), F.count("r").alias("n_records"),
        F.sum(F.octet_length("r.record").cast("bigint")).alias("n_bytes"), F.count_if(F.col("r.crc32_checksum").isNull() & F.col("r").isNotNull()).alias("n_unchecked"),
        F.max("r.lsn").alias("last_lsn"),
    )


@query
def stream_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at least 1,024 bytes, but for the last, that a sender makes of each consumer's records, in the order of arrival."""
    r = table(spark, sf_dir, "stream_batches").select("consumer_id", "batch_id", F.posexplode("records").alias("pos", "r"))
    flat = r.select("consumer_id", "batch_id", "pos", F.octet_length("r.record").cast("bigint").alias("n_bytes"))
    out = metrics.flushes(flat, "consumer_id", F.floor(F.col("batch_id") / 4096), ["batch_id", "pos"], F.col("n_bytes"), 1024)
    return out.groupBy("consumer_id", "batch_no").agg(F.count("*").alias("n_records"), F.sum("n_bytes").alias("n_bytes"))


@query
def relay_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's records and whether they follow each other."""
    return replication.relayed(table(spark, sf_dir, "stream_batches"))


@query
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that more than one consumer follows."""
    lists = table(spark, sf_dir, "stream_requests").groupBy("consumer_id").agg(F.collect_set("ns_name").alias("names"), F.lit(None).cast("int").alias("threshold"))
    flat, twice = replication.namespace_settings(lists, "names", "threshold", 100)
    return flat.join(twice, "ns_name", "left_semi").groupBy("ns_name").agg(F.count("*").alias("n"))


@query
def namespace_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a committed order."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return replication.without(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query
def member_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members to add, update and remove: consumers of the batches against those of the requests, by their last namespace."""
    a = table(spark, sf_dir, "stream_requests").groupBy("consumer_id").agg(F.max("ns_name").alias("address"))
    b = table(spark, sf_dir, "stream_batches").groupBy("consumer_id").agg(F.min("ns_name").alias("address"))
    return replication.reconciled(a, b, "consumer_id", "address")


# ---- metrics ------------------------------------------------------------------------------------------------------


@query
def log_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and entries by namespace, operation, type and transaction state."""
    r = segments.distinct_records(table(spark, sf_dir, "log_records"), "operation_type", "entry_type", "txn_state", "entries")
    return r.groupBy("ns_name", "operation_type", "entry_type", "txn_state").agg(F.count("*").alias("n_records"), F.sum(F.coalesce(F.size("entries"), F.lit(0)).cast("bigint")).alias("n_entries"))


#: Times above this are nanoseconds: as milliseconds they would lie beyond the year 30000.
MOST_MS = 1_000_000_000_000_000


def hlc_ms() -> Column:
    """A record's time in milliseconds; placeholders have theirs in nanoseconds."""
    return F.when(F.col("hlc") > MOST_MS, F.floor(F.col("hlc") / 1_000_000)).otherwise(F.col("hlc"))


@query
def log_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds from a record's time to its arrival, by namespace; n counts the records that have a time."""
    log = table(spark, sf_dir, "log_records")
    late = log.withColumn("ms", (F.unix_micros(F.col("ingested_at").cast("timestamp")) / 1000).cast("bigint") - hlc_ms())
    return metrics.quantiles(late, ["ns_name"], "ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select("ns_name", "n", *[F.round(c, 3).alias(c) for c in ("p50", "p90", "p99")])


@query
def op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query
def op_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of all types, and the change from the hour before."""
    hours = metrics.rates(table(spark, sf_dir, "events"), "ts", "hour", [])
    return hours.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n", "delta")


@query
def op_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations and errors by user."""
    return metrics.op_counts(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error")


@query
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the time since the newest one, in age buckets."""
    r = table(spark, sf_dir, "stream_requests").where("requested_at IS NOT NULL").select(F.unix_micros(F.col("requested_at").cast("timestamp")).alias("us"), F.lit(1).alias("one"))
    now = r.groupBy("one").agg(F.max("us").alias("now"))
    aged = r.join(F.broadcast(now), "one").select(metrics.age_bucket((F.col("now") - F.col("us")) / 1_000_000).alias("bucket"))
    return aged.groupBy("bucket").agg(F.count("*").alias("n"))


@query
def txn_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of six hours."""
    found = metrics.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("user_id", stamp("started_at"), stamp("ended_at"), "n")


@query
def put_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts by namespace whose checksum is right, wrong or absent, each request once."""
    p = table(spark, sf_dir, "put_requests").dropDuplicates(["put_id"])
    kind = F.when(F.col("crc32_checksum").isNull(), "absent").when(F.crc32(F.coalesce("put_value", F.unhex(F.lit("")))) == F.col("crc32_checksum"), "right").otherwise("wrong")
    return p.groupBy("ns_name", kind.alias("checksum")).agg(F.count("*").alias("n"))


@query
def put_checksums_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRC-32C of every put's value, as segments frame it."""
    ship(spark)
    p = table(spark, sf_dir, "put_requests").where("put_value IS NOT NULL")
    return p.select("put_id", "put_value").dropDuplicates(["put_id"]).select("put_id", checksums.crc32c_column(F.col("put_value")).alias("crc32c"))


# ---- merges -------------------------------------------------------------------------------------------------------


@query
def crdt_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id", "value")
    return crdt.lww(events, ["user_id"], "at_us", "event_id", "value")


@query
def crdt_gcounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("replica"), F.floor("value").alias("count"))
    return crdt.gcounter(events, ["user_id"], "replica", "count").withColumnRenamed("count", "total")


def log_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that the log's KV values hold as JSON."""
    rows = txn.effective(table(spark, sf_dir, "log_records")).where("entry_type = 'KV' AND operation_type = 'Insert' AND entry_key IS NOT NULL")
    return crdt.parsed(rows.select("ns_name", F.hex("entry_key").alias("key_hex"), "entry_value"), "entry_value")


@query
def log_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_updates(spark, sf_dir).where("reg IS NOT NULL").select("ns_name", "key_hex", "reg.timestamp", "reg.replica", "reg.value")
    return crdt.lww(found, ["ns_name", "key_hex"], "timestamp", "replica", "value")


@query
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_updates(spark, sf_dir).where("ctr IS NOT NULL").select("ns_name", "key_hex", "ctr.replica", F.col("ctr.count").alias("total"))
    return crdt.gcounter(found, ["ns_name", "key_hex"], "replica", "total")


# ---- keys and chunks ----------------------------------------------------------------------------------------------


@query
def typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed keys of all put keys."""
    k = table(spark, sf_dir, "put_requests").where("put_key IS NOT NULL").select("put_key").distinct()
    c = F.col("put_key")
    return k.select(
        F.hex(c).alias("key_hex"), F.hex(keys.kv_key(c)).alias("kv_hex"), F.hex(keys.row_key(c)).alias("row_hex"),
        F.hex(keys.cell_key(c, F.lit("c1"))).alias("cell_hex"), F.hex(keys.chunk_key(c, F.lit(3))).alias("chunk_hex"), keys.kind_of(keys.row_key(c)).alias("kind"),
    )


@query
def lob_chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut into chunks of 64 bytes: number, length, checksum of each."""
    p = table(spark, sf_dir, "primary_kv").where("put_value IS NOT NULL").select("ns_name", "put_key", "put_value").distinct()
    cut = p.select("ns_name", "put_key", "put_value", F.explode(text.chunk_spans(F.octet_length("put_value").cast("bigint"), 64)).alias("s"))
    piece = F.substring(F.col("put_value"), (F.col("s.at") + 1).cast("int"), F.col("s.length").cast("int"))
    return cut.select("ns_name", F.hex("put_key").alias("key_hex"), F.col("s.chunk_no").cast("bigint").alias("chunk_no"), "s.length", F.md5(piece).alias("md5"))


@query
def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the streamed records take in a segment, by namespace."""
    r = table(spark, sf_dir, "stream_batches").select("ns_name", F.explode("records").alias("r"))
    size = F.octet_length("r.record").cast("bigint")
    return r.groupBy("ns_name").agg(F.sum(text.record_size(size)).alias("n_bytes"), F.sum(text.varint_size(F.col("r.lsn")).cast("bigint")).alias("varint_bytes"))
