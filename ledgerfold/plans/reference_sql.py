"""SQL counterparts of the queries in reference.py, for DuckDB over the same tables."""

#: The log with each record once.
LOG = "WITH log AS (SELECT DISTINCT ON (ns_name, lsn) * FROM log_records)"

#: The entries that take effect, with their order, and the values that they leave.
EFFECTIVE = (
    LOG
    + """
, done AS (
  SELECT ns_name, txn_id, min(lsn) AS commit_lsn, arg_min(operation_type, lsn) AS op FROM log WHERE txn_state = 'Commit' GROUP BY ALL
), rec AS (
  SELECT ns_name, entry_type, operation_type AS op, lsn AS commit_lsn, lsn, entries FROM log
  WHERE txn_state = 'None' AND entry_type IN ('KV', 'Row') AND operation_type IN ('Insert', 'Delete', 'DeleteRowByKey')
  UNION ALL
  SELECT l.ns_name, l.entry_type, d.op, d.commit_lsn, l.lsn, l.entries FROM log l
  JOIN done d ON d.ns_name = l.ns_name AND d.txn_id = l.txn_id AND l.lsn < d.commit_lsn WHERE l.txn_state = 'Prepare'
), flat AS (
  SELECT ns_name, entry_type, op, commit_lsn, lsn, unnest(range(len(entries))) AS entry_no, unnest(entries) AS e FROM rec
), eff AS (
  SELECT ns_name, entry_type, op, commit_lsn, lsn, entry_no, e.entry_key AS k, e.entry_value AS v, e.cells AS cells, (commit_lsn, lsn, entry_no) AS ord
  FROM flat WHERE e.entry_key IS NOT NULL
)"""
)

STATE = (
    EFFECTIVE
    + """
, bars AS (SELECT ns_name, k, max(ord) AS bar FROM eff WHERE entry_type = 'Row' AND op = 'DeleteRowByKey' GROUP BY ALL),
cell_changes AS (
  SELECT ns_name, k, op, ord, unnest(map_keys(cells)) AS cell_name, unnest(map_values(cells)) AS v FROM eff WHERE entry_type = 'Row' AND op <> 'DeleteRowByKey'
), kv AS (
  SELECT ns_name, k, arg_max({'v': v, 'op': op}, ord) AS b, max(ord) AS o FROM eff WHERE entry_type = 'KV' GROUP BY ALL HAVING arg_max(op, ord) = 'Insert'
), cell_best AS (
  SELECT ns_name, k, cell_name, arg_max({'v': v, 'op': op}, ord) AS b, max(ord) AS o FROM cell_changes GROUP BY ALL
), cells AS (
  SELECT c.ns_name, c.k, c.cell_name, c.b, c.o FROM cell_best c LEFT JOIN bars r ON r.ns_name = c.ns_name AND r.k = c.k
  WHERE c.b.op = 'Insert' AND (r.bar IS NULL OR c.o > r.bar)
), newest AS (SELECT ns_name, k, max(commit_lsn) AS commit_lsn FROM eff WHERE entry_type = 'Chunked' GROUP BY ALL),
parts AS (
  SELECT e.ns_name, e.k, e.v, row_number() OVER (PARTITION BY e.ns_name, e.k ORDER BY e.ord) - 1 AS chunk_no, count(*) OVER (PARTITION BY e.ns_name, e.k) AS n
  FROM eff e JOIN newest w ON w.ns_name = e.ns_name AND w.k = e.k AND w.commit_lsn = e.commit_lsn WHERE e.entry_type = 'Chunked'
)"""
)

HEADERS = """
WITH h AS (
  SELECT * FROM segment_headers QUALIFY row_number() OVER (
    PARTITION BY ns_name, segment_id ORDER BY last_modified_at DESC NULLS LAST, entry_count DESC NULLS LAST, write_offset DESC NULLS LAST) = 1
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY ns_name) AS n, row_number() OVER (PARTITION BY ns_name ORDER BY segment_id) AS rank FROM h
)"""

SEGMENTS = LOG + ", seg AS (SELECT ns_name, segment_id, count(*) AS n_records, min(lsn) AS first_lsn, max(lsn) AS last_lsn, max(seg_offset) AS last_offset FROM log GROUP BY ALL)"

TXNS = (
    LOG
    + """
, txns AS (
  SELECT ns_name, txn_id, count(*) FILTER (txn_state = 'Prepare') AS n_prepared, min(lsn) AS first_lsn, max(lsn) AS last_lsn,
    min(hlc) AS first_ms, max(hlc) AS last_ms, CASE WHEN bool_or(txn_state = 'Commit') THEN 'committed' ELSE 'open' END AS status
  FROM log WHERE txn_id IS NOT NULL GROUP BY ns_name, txn_id
)"""
)

CELLS_OF_EVENTS = """
WITH c AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS cell_name, event_id, value, event_type = 'error' AS removed
  FROM events WHERE event_type <> 'signup'
), b AS (SELECT user_id, max(event_id) AS bar FROM events WHERE event_type = 'signup' GROUP BY ALL),
best AS (SELECT user_id, cell_name, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(removed, event_id) AS removed FROM c GROUP BY ALL),
live AS (SELECT user_id, cell_name, event_id, value FROM best LEFT JOIN b USING (user_id) WHERE NOT removed AND (bar IS NULL OR event_id > bar))
"""

AGES = """CASE WHEN s < 1 THEN '0s_1s' WHEN s < 10 THEN '1s_10s' WHEN s < 30 THEN '10s_30s' WHEN s < 60 THEN '30s_1m' WHEN s < 600 THEN '1m_10m'
  WHEN s < 900 THEN '10m_15m' WHEN s < 1800 THEN '10m_30m' WHEN s < 3600 THEN '30m_1h' WHEN s < 21600 THEN '1h_6h' WHEN s < 43200 THEN '6h_12h'
  WHEN s < 86400 THEN '12h_24h' ELSE '24h_over' END"""


def be(number: str, digits: int) -> str:
    return f"lpad(printf('%X', CAST({number} AS BIGINT)), {digits}, '0')"


def gaps(rows: str) -> str:
    """Missing numbers between neighbours of rows (s, n)."""
    return f"""
, o AS (SELECT s, n, lag(n) OVER (PARTITION BY s ORDER BY n) AS p FROM (SELECT DISTINCT s, n FROM ({rows})))
SELECT s AS ns_name, p + 1 AS from_seq, n - 1 AS to_seq FROM o WHERE n > p + 1"""




def crc(polynomial: int, rows: str) -> str:
    """Checksums of the column v of rows, which DuckDB has no function for: the table of 256 values, then a fold over the bytes."""
    return f"""
WITH RECURSIVE steps(i, k, x) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, {polynomial}) ELSE x >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(x ORDER BY i) AS t FROM steps WHERE k = 8),
r AS ({rows}),
c AS (
  SELECT r.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(v)), lambda i: ('0x' || substr(hex(v), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM r, tab
)"""


SQL = {
    "put_checksums": crc(3988292384, "SELECT DISTINCT ON (put_id) ns_name, crc32_checksum, coalesce(put_value, ''::BLOB) AS v FROM put_requests")
    + """ SELECT ns_name, CASE WHEN crc32_checksum IS NULL THEN 'absent' WHEN crc = crc32_checksum THEN 'right' ELSE 'wrong' END AS checksum, count(*) AS n FROM c GROUP BY ALL""",
    "put_checksums_c": crc(2197175160, "SELECT DISTINCT ON (put_id) put_id, put_value AS v FROM put_requests WHERE put_value IS NOT NULL") + " SELECT put_id, crc AS crc32c FROM c",
    "log_point": "SELECT DISTINCT ns_name, lsn FROM log_records WHERE segment_id = 40 AND seg_offset = 64",
    "log_availability": """WITH h AS (SELECT ns_name, min(lsn) AS lo, max(lsn) AS hi FROM log_records GROUP BY ALL),
w AS (SELECT DISTINCT consumer_id, ns_name, start_lsn AS lsn FROM stream_requests WHERE start_lsn IS NOT NULL)
SELECT consumer_id, ns_name, lsn, CASE WHEN lo IS NULL OR lsn > hi THEN 'not_yet' WHEN lsn < lo THEN 'truncated' ELSE 'ok' END AS status FROM w LEFT JOIN h USING (ns_name)""",
    "log_replaced": LOG
    + """, b AS (SELECT ns_name, (min(lsn) + max(lsn)) // 2 AS mid FROM log GROUP BY ALL),
s AS (SELECT l.ns_name, l.lsn, l.operation_type, false AS is_new FROM log l JOIN b USING (ns_name) WHERE lsn < mid
  UNION ALL SELECT l.ns_name, l.lsn, 'NoOperation', true FROM log l JOIN b USING (ns_name) WHERE lsn BETWEEN mid AND mid + 9)
SELECT ns_name, count(*) AS n, count(*) FILTER (is_new) AS n_new, max(lsn) AS last_lsn FROM s GROUP BY ALL""",
    "relay_batches": """WITH f AS (SELECT DISTINCT consumer_id, ns_name, batch_id, unnest(records).lsn AS lsn FROM stream_batches)
SELECT consumer_id, ns_name, batch_id, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn, max(lsn) - min(lsn) + 1 = count(*) AS is_contiguous FROM f GROUP BY ALL""",
    "namespace_counts": """WITH c AS (SELECT consumer_id, list(DISTINCT ns_name) AS ns FROM stream_requests GROUP BY ALL), f AS (SELECT unnest(ns) AS ns_name FROM c)
SELECT ns_name, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1""",
    "log_kv": STATE + " SELECT ns_name, hex(k) AS entry_key, hex(b.v) AS value, o[1] AS commit_lsn, o[2] AS lsn, o[3] AS entry_no FROM kv",
    "log_row_cells": STATE + " SELECT ns_name, hex(k) AS entry_key, cell_name, hex(b.v) AS value, o[1] AS commit_lsn, o[2] AS lsn, o[3] AS entry_no FROM cells",
    "log_rows": STATE + " SELECT ns_name, hex(k) AS entry_key, count(*) AS n_cells, string_agg(cell_name, ',' ORDER BY cell_name) AS cell_names FROM cells GROUP BY ns_name, k",
    "log_row_lookup": STATE + " SELECT cell_name, hex(b.v) AS value, o[2] AS lsn FROM cells WHERE ns_name = 'main' AND k = 'row:session-board'::BLOB AND cell_name < 'f_m'",
    "log_objects": STATE
    + """ SELECT ns_name, hex(k) AS entry_key, count(*) AS n_chunks, CAST(sum(octet_length(v)) AS BIGINT) AS n_bytes,
  md5(unhex(string_agg(hex(v), '' ORDER BY chunk_no))) AS md5 FROM parts GROUP BY ns_name, k""",
    "log_object_chunks": STATE
    + """ SELECT ns_name, hex(k) AS entry_key, chunk_no, octet_length(v) AS n_bytes,
  CASE WHEN chunk_no = 0 THEN 'first' WHEN chunk_no = n - 1 THEN 'last' ELSE 'middle' END AS label FROM parts""",
    "log_three_views": STATE
    + """, keys AS (SELECT ns_name, k, 'KV' AS t FROM kv UNION SELECT ns_name, k, 'Row' FROM cells UNION SELECT ns_name, k, 'Chunked' FROM parts)
SELECT ns_name, hex(k) AS entry_key, string_agg(t, ',' ORDER BY t) AS entry_types FROM keys GROUP BY ns_name, k HAVING count(*) > 1""",
    "log_events": LOG
    + """, flat AS (SELECT ns_name, lsn, unnest(range(len(entries))) AS entry_no, unnest(entries) AS e FROM log WHERE entry_type = 'Event')
SELECT ns_name, lsn, entry_no, hex(e.entry_key) AS entry_key, hex(e.entry_value) AS entry_value FROM flat""",
    "log_notifications": EFFECTIVE
    + """, m AS (SELECT DISTINCT ns_name || '.' || CASE entry_type WHEN 'KV' THEN 'kv' WHEN 'Row' THEN 'row' ELSE 'lob' END AS topic,
  CASE op WHEN 'Insert' THEN 'put' WHEN 'Delete' THEN 'delete' ELSE 'delete_row' END AS operation, k, commit_lsn FROM eff)
SELECT topic, operation, count(*) AS n, max(commit_lsn) AS last_seq FROM m GROUP BY ALL""",
    "log_recover": STATE
    + """, live AS (
  SELECT ns_name, 'KV' AS entry_type, o[2] AS lsn, o[3] AS entry_no FROM kv UNION ALL SELECT ns_name, 'Row', o[2], o[3] FROM cells
  UNION ALL SELECT e.ns_name, 'Chunked', e.lsn, e.entry_no FROM eff e JOIN newest w ON w.ns_name = e.ns_name AND w.k = e.k AND w.commit_lsn = e.commit_lsn WHERE e.entry_type = 'Chunked'
)
SELECT ns_name, entry_type, count(*) AS n_values, CAST(sum(lsn) AS BIGINT) AS sum_lsn, CAST(sum(entry_no) AS BIGINT) AS sum_entry_no FROM live GROUP BY ALL""",
    "log_transactions": TXNS + " SELECT ns_name, hex(txn_id) AS txn_id, n_prepared, first_lsn, last_lsn, first_ms, last_ms, status FROM txns",
    "log_txn_status": TXNS
    + " SELECT ns_name, status, count(*) AS n, CAST(sum(n_prepared) AS BIGINT) AS n_prepared, CAST(sum(last_ms - first_ms) AS BIGINT) AS sum_ms FROM txns GROUP BY ALL",
    "log_stale_txns": TXNS
    + """, now AS (SELECT ns_name, max(CASE WHEN operation_type = 'RaftInternal' THEN hlc // 1000000 ELSE hlc END) AS now_ms FROM log GROUP BY ALL)
SELECT ns_name, hex(txn_id) AS txn_id, n_prepared, first_lsn FROM txns JOIN now USING (ns_name)
WHERE status = 'open' AND (now_ms - last_ms >= 120000 OR now_ms - first_ms >= 900000)""",
    "log_invisible": LOG
    + """, lost AS (
  SELECT ns_name, entry_type, lsn, unnest(range(len(entries))) AS entry_no FROM log l WHERE txn_state = 'Prepare'
  AND NOT EXISTS (SELECT 1 FROM log c WHERE c.txn_state = 'Commit' AND c.ns_name = l.ns_name AND c.txn_id = l.txn_id AND l.lsn < c.lsn)
)
SELECT ns_name, entry_type, count(*) AS n, min(lsn) AS first_lsn FROM lost GROUP BY ALL""",
    "txn_visible": """SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""",
    "txn_invisible": """SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""",
    "txn_commit_order": """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
    "kv_latest": """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""",
    "kv_versions": "SELECT user_id, count(*) AS n_versions, count(*) FILTER (event_type = 'error') AS n_tombstones, max(event_id) AS last_order FROM events GROUP BY ALL",
    "row_cells": CELLS_OF_EVENTS + "SELECT user_id, cell_name, event_id, value FROM live",
    "row_columns_filter": CELLS_OF_EVENTS + "SELECT user_id, cell_name, event_id, value FROM live WHERE cell_name IN ('view', 'purchase')",
    "barrier_rows": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup'",
    "multi_ns_latest": """SELECT e.user_id, e.event_type, e.value, c.c_mktsegment FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) e
JOIN customer c ON c.c_custkey = e.user_id""",
    "recover_incremental": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "log_segments": SEGMENTS + " SELECT * FROM seg",
    "segment_list": HEADERS
    + """ SELECT ns_name, segment_id, lpad(CAST(segment_id AS VARCHAR), 9, '0') || '.seg' AS file_name,
  CASE WHEN flags & 2 <> 0 THEN 'Sealed' ELSE 'Active' END AS status, entry_count, write_offset, first_log_index FROM h""",
    "segment_totals": HEADERS
    + """ SELECT ns_name, count(*) AS n_segments, count(*) FILTER (flags & 2 <> 0) AS n_sealed, count(*) FILTER (flags & 2 = 0) AS n_active,
  CAST(sum(entry_count) AS BIGINT) AS n_entries, CAST(sum(write_offset) AS BIGINT) AS n_bytes, min(first_log_index) FILTER (first_log_index > 0) AS first_index,
  max(first_log_index + entry_count - 1) FILTER (first_log_index > 0) AS last_index FROM h GROUP BY ALL""",
    "segment_retention": HEADERS + " SELECT ns_name, segment_id FROM ranked WHERE flags & 2 <> 0 AND rank <= least(n - 5, n - 1)",
    "segment_cleanup": HEADERS
    + """, marks AS (SELECT ns_name, (min(segment_id) + max(segment_id)) // 2 AS mark FROM log_records GROUP BY ALL)
SELECT ns_name, segment_id FROM ranked JOIN marks USING (ns_name) WHERE flags & 2 <> 0 AND rank <= least(n - 5, n - 1) AND segment_id < mark""",
    "segment_backup": HEADERS
    + """ SELECT ns_name, segment_id, entry_count, segment_id = max(segment_id) OVER (PARTITION BY ns_name) AS is_last FROM h WHERE flags & 2 <> 0 AND segment_id > 40""",
    "segment_check": SEGMENTS
    + """, h AS (SELECT * FROM segment_headers QUALIFY row_number() OVER (
    PARTITION BY ns_name, segment_id ORDER BY last_modified_at DESC NULLS LAST, entry_count DESC NULLS LAST, write_offset DESC NULLS LAST) = 1)
SELECT ns_name, segment_id, entry_count, n_records, first_log_index, first_lsn FROM h FULL JOIN seg USING (ns_name, segment_id)
WHERE entry_count IS DISTINCT FROM n_records OR first_log_index IS DISTINCT FROM first_lsn""",
    "segment_stats": "SELECT event_id // 1000 + 1 AS segment_id, count(*) AS n_records, min(event_id) AS first_lsn, max(event_id) AS last_lsn FROM events GROUP BY ALL",
    "retention_oldest": "SELECT event_id // 1000 + 1 AS segment_id, count(*) AS n_records FROM events GROUP BY ALL ORDER BY 1 LIMIT 4",
    "log_bounds": "SELECT ns_name, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM log_records GROUP BY ALL",
    "log_gaps": LOG + gaps("SELECT ns_name AS s, lsn AS n FROM log WHERE operation_type <> 'RaftInternal'"),
    "lsn_gaps": "WITH one AS (SELECT 1)" + gaps("SELECT 'events' AS s, event_id AS n FROM events WHERE event_type <> 'view'"),
    "log_scan_from": "SELECT DISTINCT ns_name, segment_id, seg_offset, lsn FROM log_records WHERE (segment_id, seg_offset) >= (40, 512)",
    "log_range": f"SELECT DISTINCT ns_name, lsn, {be('lsn', 16)} AS key_hex, lsn AS decoded FROM log_records WHERE lsn > 2100 AND lsn <= 2200",
    "log_positions": LOG
    + """, p AS (
  SELECT ns_name, lsn, list_reduce(list_transform(range(4), lambda i: ('0x' || substr(hex(prev_txn_wal_index), 2 * i + 1, 2))::BIGINT << (8 * i)), lambda a, b: a + b) AS segment_id,
    list_reduce(list_transform(range(7), lambda i: ('0x' || substr(hex(prev_txn_wal_index), 2 * i + 9, 2))::BIGINT << (8 * i)), lambda a, b: a + b) AS seg_offset
  FROM log WHERE prev_txn_wal_index IS NOT NULL
)
SELECT p.ns_name, p.lsn, l.lsn AS prev_lsn FROM p JOIN log l ON l.ns_name = p.ns_name AND l.segment_id = p.segment_id AND l.seg_offset = p.seg_offset""",
    "log_committed": LOG
    + """, a AS (SELECT ns_name, count(*) AS n_committed FROM log WHERE (segment_id, seg_offset) <= (45, 1024) GROUP BY ALL),
b AS (SELECT ns_name, count(*) AS n_kept FROM log WHERE lsn <= 3000 GROUP BY ALL)
SELECT ns_name, n_committed, n_kept FROM a FULL JOIN b USING (ns_name)""",
    "replica_ready": LOG
    + """, f AS (SELECT ns_name, min(lsn) + 100 AS last_lsn FROM log GROUP BY ALL),
seen AS (SELECT l.ns_name, l.lsn FROM log l JOIN f USING (ns_name) WHERE l.lsn > f.last_lsn AND operation_type <> 'RaftInternal' UNION SELECT ns_name, last_lsn FROM f),
g AS (SELECT ns_name, min(lsn + 1) AS first_missing FROM (SELECT ns_name, lsn, lead(lsn) OVER (PARTITION BY ns_name ORDER BY lsn) AS nx FROM seen) WHERE nx IS NULL OR nx > lsn + 1 GROUP BY ALL)
SELECT ns_name, last_lsn, first_missing, first_missing - last_lsn - 1 AS n_ready FROM f JOIN g USING (ns_name)""",
    "replica_lag": """WITH o AS (SELECT user_id, max(event_id) AS last_id FROM events GROUP BY ALL), h AS (SELECT max(event_id) AS head FROM events)
SELECT user_id, last_id, greatest(head - last_id, 0) AS lag, greatest(head - last_id, 0) > 100 AS is_behind FROM o, h""",
    "follower_lag": """WITH h AS (SELECT ns_name, max(lsn) AS head FROM log_records GROUP BY ALL),
d AS (SELECT consumer_id, ns_name, max(latest_lsn) FILTER (outcome = 'ok') AS at_lsn FROM stream_requests GROUP BY ALL)
SELECT consumer_id, ns_name, at_lsn, greatest(head - coalesce(at_lsn, 0), 0) AS lag, greatest(head - coalesce(at_lsn, 0), 0) > 500 AS is_behind FROM d JOIN h USING (ns_name)""",
    "stream_batches_stats": """WITH r AS (SELECT consumer_id, ns_name, batch_id, unnest(CASE WHEN len(records) > 0 THEN records ELSE [NULL] END) AS r FROM stream_batches)
SELECT consumer_id, ns_name, count(DISTINCT batch_id) AS n_batches, count(r) AS n_records, CAST(sum(octet_length(r.record)) AS BIGINT) AS n_bytes,
  count(*) FILTER (r IS NOT NULL AND r.crc32_checksum IS NULL) AS n_unchecked, max(r.lsn) AS last_lsn FROM r GROUP BY ALL""",
    "stream_flushes": """WITH RECURSIVE f AS (SELECT consumer_id, batch_id, unnest(range(len(records))) AS pos, coalesce(octet_length(unnest(records).record), 0) AS n FROM stream_batches),
c AS (SELECT consumer_id, n, row_number() OVER w AS i, (sum(n) OVER w)::BIGINT AS upto FROM f WINDOW w AS (PARTITION BY consumer_id ORDER BY batch_id, pos ROWS UNBOUNDED PRECEDING)),
nxt AS (SELECT consumer_id, i, min(i) OVER (PARTITION BY consumer_id ORDER BY upto RANGE BETWEEN greatest(1024 - n, 0) FOLLOWING AND UNBOUNDED FOLLOWING) AS last FROM c),
walk AS (SELECT DISTINCT consumer_id, 1::BIGINT AS i, 0::BIGINT AS batch_no FROM c UNION ALL SELECT consumer_id, last + 1, batch_no + 1 FROM walk JOIN nxt USING (consumer_id, i) WHERE last IS NOT NULL),
cut AS (SELECT consumer_id, batch_no, i AS lo, coalesce(lead(i) OVER (PARTITION BY consumer_id ORDER BY i), 9223372036854775807) AS hi FROM walk)
SELECT c.consumer_id, batch_no, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_bytes FROM c JOIN cut w ON c.consumer_id = w.consumer_id AND c.i >= w.lo AND c.i < w.hi GROUP BY ALL""",
    "namespace_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "member_changes": """WITH a AS (SELECT consumer_id, max(ns_name) AS m FROM stream_requests GROUP BY ALL), b AS (SELECT consumer_id, min(ns_name) AS s FROM stream_batches GROUP BY ALL)
SELECT consumer_id, CASE WHEN s IS NULL THEN 'add' WHEN m IS NULL THEN 'remove' ELSE 'update' END AS action FROM a FULL JOIN b USING (consumer_id) WHERE s IS DISTINCT FROM m""",
    "log_ops": LOG
    + """ SELECT ns_name, operation_type, entry_type, txn_state, count(*) AS n_records, CAST(sum(coalesce(len(entries), 0)) AS BIGINT) AS n_entries FROM log GROUP BY ALL""",
    "log_latency": """WITH l AS (SELECT ns_name, epoch_us(ingested_at) // 1000 - CASE WHEN operation_type = 'RaftInternal' THEN hlc // 1000000 ELSE hlc END AS ms FROM log_records)
SELECT ns_name, count(ms) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.9), 3) AS p90, round(quantile_cont(ms, 0.99), 3) AS p99 FROM l GROUP BY ALL""",
    "op_stats": """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY ALL""",
    "op_rate": """WITH h AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, n, n - lag(n) OVER (ORDER BY b) AS delta FROM h""",
    "op_errors": "SELECT user_id, count(*) AS n_ops, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY ALL",
    "age_buckets": f"""WITH r AS (SELECT (max(epoch_us(requested_at)) OVER () - epoch_us(requested_at)) / 1000000 AS s FROM stream_requests WHERE requested_at IS NOT NULL)
SELECT {AGES} AS bucket, count(*) AS n FROM r GROUP BY ALL""",
    "txn_idle_sessions": """WITH m AS (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended_at, count(*) AS n FROM g GROUP BY user_id, no""",
    "crdt_lww": """WITH b AS (SELECT user_id, epoch_us(ts) AS at_us, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, value, at_us, event_id FROM b""",
    "crdt_gcounter": """WITH r AS (SELECT user_id, event_id % 3 AS replica, max(CAST(floor(value) AS BIGINT)) AS m FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(m) AS BIGINT) AS total FROM r GROUP BY ALL""",
    "log_registers": EFFECTIVE
    + """, u AS (SELECT ns_name, hex(k) AS key_hex, decode(v) AS j FROM eff WHERE entry_type = 'KV' AND op = 'Insert' AND hex(v) LIKE '7B22%'),
r AS (SELECT ns_name, key_hex, CAST(j ->> '$.timestamp' AS BIGINT) AS t, j ->> '$.replica' AS r, j ->> '$.value' AS value FROM u WHERE j ->> '$.timestamp' IS NOT NULL AND j ->> '$.replica' IS NOT NULL)
SELECT ns_name, key_hex, value, t AS timestamp, r AS replica FROM (SELECT DISTINCT * FROM r) QUALIFY row_number() OVER (PARTITION BY ns_name, key_hex ORDER BY t DESC, r DESC, value DESC) = 1""",
    "log_counters": EFFECTIVE
    + """, u AS (SELECT ns_name, hex(k) AS key_hex, decode(v) AS j FROM eff WHERE entry_type = 'KV' AND op = 'Insert' AND hex(v) LIKE '7B22%'),
r AS (SELECT ns_name, key_hex, j ->> '$.replica' AS replica, max(CAST(j ->> '$.count' AS BIGINT)) AS m FROM u WHERE j ->> '$.count' IS NOT NULL GROUP BY ALL)
SELECT ns_name, key_hex, CAST(sum(m) AS BIGINT) AS total FROM r GROUP BY ALL""",
    "typed_keys": f"""WITH k AS (SELECT DISTINCT hex(put_key) AS h, octet_length(put_key) AS n FROM put_requests WHERE put_key IS NOT NULL)
SELECT h AS key_hex, CASE WHEN h LIKE 'FE%' THEN h ELSE 'FE' || h END AS kv_hex, 'FD' || {be('n', 8)} || h AS row_hex,
  'FD' || {be('n', 8)} || h || '6331' AS cell_hex, 'FF' || {be('n', 8)} || h || '00000003' AS chunk_hex, 'Row' AS kind FROM k""",
    "lob_chunk_split": """WITH p AS (SELECT DISTINCT ns_name, put_key, put_value, hex(put_value) AS h FROM primary_kv WHERE put_value IS NOT NULL),
c AS (SELECT ns_name, put_key, h, unnest(range((octet_length(put_value) + 63) // 64)) AS chunk_no FROM p)
SELECT ns_name, hex(put_key) AS key_hex, chunk_no, length(substr(h, chunk_no * 128 + 1, 128)) // 2 AS length, md5(unhex(substr(h, chunk_no * 128 + 1, 128))) AS md5 FROM c""",
    "record_sizes": """WITH r AS (SELECT ns_name, unnest(records) AS r FROM stream_batches)
SELECT ns_name, CAST(sum((octet_length(r.record) + 16 + 7) // 8 * 8) AS BIGINT) AS n_bytes, CAST(sum((length(bin(r.lsn)) + 6) // 7) AS BIGINT) AS varint_bytes FROM r GROUP BY ALL""",
}
