"""SQL counterparts of the queries in tools.py. What is written and read again is what the tables hold; texts are made by SQL's own functions."""

from .general_sql import P1_FOUND
from .reference_sql import EFFECTIVE, LOG

BLOB = "encode(%s)"
OFFSET_BYTES = "printf('%02X%02X%02X%02X', {0} % 256, ({0} // 256) % 256, ({0} // 65536) % 256, ({0} // 16777216) % 256)"
HEX = "hex(n_name::BLOB)"
DECIMALS = "CASE WHEN {0} = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.2f', round({0}, 2)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END"
DURATION = """CASE WHEN s < 60 THEN s || 's' ELSE
  CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s >= 3600 THEN ((s // 3600) % 24) || 'h ' ELSE '' END || ((s // 60) % 60) || 'm ' || (s % 60) || 's' END"""
LIST = ("SELECT DISTINCT ON (ns_name, segment_id) *, CASE WHEN flags & 2 <> 0 THEN 'sealed' ELSE 'active' END AS status FROM segment_headers "
        "ORDER BY ns_name, segment_id, last_modified_at DESC NULLS LAST, entry_count DESC NULLS LAST, write_offset DESC NULLS LAST")  # fmt: skip
GC = """g AS (SELECT event_id AS cycle, round(event_id / 10, 1) AS at_s, CASE WHEN event_id % 5 = 0 THEN round(value, 1) + 2.0 ELSE round(value, 1) + 0.5 END AS pause_ms,
  (CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 3.0 END)::DOUBLE AS concurrent_ms, user_id FROM events WHERE event_id % 11 <> 0)"""
LIVE = P1_FOUND

SQL = {
    "writer_state": """SELECT 'KV' AS entry_type, hex(n_name) AS key_hex, '' AS cell_name, hex(CASE WHEN n_regionkey = 0 THEN 'txn' ELSE n_regionkey::VARCHAR END) AS value_hex FROM nation WHERE n_regionkey <> 3 AND (n_nationkey <> 24 OR n_regionkey = 0)
UNION ALL SELECT 'KV', hex('after'), '', hex('0')
UNION ALL SELECT 'Row', hex(r_name), 'id', hex(r_regionkey::VARCHAR) FROM region WHERE r_regionkey <> 2
UNION ALL SELECT 'Row', hex(r_name), 'name', hex(r_name) FROM region WHERE r_regionkey NOT IN (1, 2)
UNION ALL SELECT 'Row', hex(r_name), 't', hex((r_regionkey * 10)::VARCHAR) FROM region
UNION ALL SELECT 'Chunked', hex(r_name), '', hex(repeat(r_name, 5)) FROM region WHERE r_regionkey <> 4
UNION ALL SELECT 'Chunked', hex('small'), '', ''""",
    "writer_checksums": """SELECT hex(r_name) AS key_hex, (length(r_name) * 5 + 7) // 8 AS n_chunks, true AS is_right FROM region UNION ALL SELECT hex('small'), 1, true""",
    "bulk_put": "SELECT DISTINCT ns_name, hex(put_key) AS entry_key, hex(put_value) AS value FROM primary_kv WHERE put_key IS NOT NULL",
    "bulk_lsns": "SELECT count(*) AS n, count(*) AS n_lsns, 101 AS first_lsn, 100 + count(*) AS last_lsn, (99 + count(*)) // 1000 + 1 AS last_segment FROM primary_kv",
    "segment_records": """WITH l AS (SELECT DISTINCT ON (ns_name, lsn) * FROM log_records)
SELECT ns_name, segment_id, lsn, coalesce(hlc, 0) AS hlc, coalesce(crc32_checksum, 0) AS crc32_checksum, operation_type, txn_state, entry_type, hex(txn_id) AS txn_id, hex(prev_txn_wal_index) AS prev_position,
  coalesce(len(entries), 0) AS n_entries, md5(coalesce(array_to_string(list_transform(entries, lambda e: concat_ws('=', hex(e.entry_key),
    CASE WHEN entry_type <> 'Row' THEN hex(e.entry_value) END, CASE WHEN entry_type = 'Row' THEN array_to_string(list_sort(map_keys(coalesce(e.cells, MAP {}))), ',') END)), ';'), '')) AS entries_md5 FROM l""",
    "segment_file_headers": """SELECT ns_name || '/' || printf('%09d.seg', segment_id) AS path, segment_id, count(DISTINCT lsn) AS entry_count, min(lsn) AS first_log_index, 2 AS flags, true AS is_valid FROM log_records GROUP BY ALL""",
    "segment_offsets": """SELECT ns_name || '/' || printf('%09d.seg', segment_id) AS path, count(DISTINCT lsn) AS n_frames, 64 AS first_offset, 0 AS n_unaligned, true AS is_full FROM log_records GROUP BY ns_name, segment_id""",
    "log_from_lsn": """SELECT ns_name, count(DISTINCT lsn) AS n_all, nullif(count(DISTINCT lsn) FILTER (lsn >= 4000), 0) AS n_from FROM log_records GROUP BY ALL""",
    "log_without_range": LOG + " SELECT ns_name, count(*) AS n, CAST(sum(lsn) AS BIGINT) AS sum_lsn FROM log WHERE lsn < 1000 OR lsn > 2500 GROUP BY ALL",
    "txn_chains": """WITH l AS (SELECT DISTINCT ON (ns_name, lsn) * FROM log_records WHERE txn_id IS NOT NULL),
pos AS (SELECT ns_name, txn_id, lsn, lower(hex(prev_txn_wal_index)) AS p, """
    + OFFSET_BYTES.format("segment_id") + " || " + OFFSET_BYTES.format("seg_offset") + """ || '00000000' AS own, txn_state, entry_type FROM l),
n AS (SELECT a.*, b.lsn AS found FROM pos a LEFT JOIN pos b ON a.ns_name = b.ns_name AND a.txn_id = b.txn_id AND upper(a.p) = b.own WHERE a.txn_state <> 'Begin')
SELECT ns_name, hex(txn_id) AS txn_id, max(entry_type) FILTER (txn_state = 'Commit') AS entry_type, count(*) FILTER (txn_state = 'Prepare') AS n_prepared, count(*) FILTER (found IS NULL) AS n_missing, count(*) FILTER (found IS NULL) = 0 AS is_complete
FROM n GROUP BY ns_name, txn_id HAVING count(*) FILTER (txn_state = 'Commit') > 0""",
    "position_checks": """WITH l AS (SELECT DISTINCT ns_name, lsn, segment_id, seg_offset, hex(prev_txn_wal_index) AS p FROM log_records),
c AS (SELECT DISTINCT ns_name, lsn - 1 AS lsn, p FROM l WHERE p IS NOT NULL),
own AS (SELECT ns_name, lsn, """ + OFFSET_BYTES.format("segment_id") + " || " + OFFSET_BYTES.format("seg_offset") + """ || '00000000' AS at FROM (SELECT ns_name, lsn, max((segment_id, seg_offset)) AS m, m[1] AS segment_id, m[2] AS seg_offset FROM l GROUP BY ns_name, lsn))
SELECT c.ns_name, CASE WHEN own.lsn IS NULL THEN 'absent' WHEN own.at = c.p THEN 'same' ELSE 'elsewhere' END AS status, count(*) AS n FROM c LEFT JOIN own USING (ns_name, lsn) GROUP BY ALL""",
    "relay_checks": """WITH r AS (SELECT consumer_id, ns_name, batch_id, server_ts, list_filter(list_transform(records, lambda x: x.lsn), lambda x: x IS NOT NULL) AS l FROM stream_batches),
f AS (SELECT consumer_id, ns_name, batch_id, server_ts, unnest(range(len(l))) AS i, unnest(l) AS lsn FROM r),
g AS (SELECT *, lag(lsn) OVER (PARTITION BY consumer_id, ns_name ORDER BY batch_id, i) AS p FROM f),
b AS (SELECT consumer_id, ns_name, batch_id, any_value(server_ts) AS server_ts, count(*) AS n, arg_min(lsn, i) AS first_lsn, arg_max(lsn, i) AS last_lsn, max(p) FILTER (i = 0) AS prev_lsn,
  count(*) FILTER (lsn <> p + 1) AS n_breaks FROM g GROUP BY ALL)
SELECT consumer_id, ns_name, batch_id, n, first_lsn, last_lsn, prev_lsn, n_breaks, (epoch_us(server_ts) - min(epoch_us(server_ts)) OVER (PARTITION BY ns_name, last_lsn)) // 1000 AS delay_ms FROM b""",
    "cluster_stats": """WITH o AS (SELECT consumer_id, count(*) FILTER (outcome = 'ok') AS n_ok, max(latest_lsn) AS top FROM stream_requests GROUP BY ALL)
SELECT count(*) AS n_servers, count(*) FILTER (n_ok > 0) AS n_voters, count(*) FILTER (top = (SELECT max(top) FROM o)) AS n_leaders FROM o""",
    "namespace_members": "SELECT DISTINCT consumer_id FROM stream_requests WHERE ns_name = 'billing'",
    "restore_plan": f"""WITH s AS (SELECT count(*) AS n FROM ({LIVE})), h AS (SELECT count(*) FILTER (flags & 2 <> 0) AS n FROM ({LIST})), a AS (SELECT unnest(['would restore', 'restored']) AS action)
SELECT 'state' AS part, action, n AS n_rows FROM s, a UNION ALL SELECT 'segments', action, n FROM h, a""",
    "restored_state": LIVE,
    "feed_compacted": LIVE,
    "feed_abandoned": LOG
    + """, lost AS (SELECT ns_name, entry_type, lsn, unnest(range(len(entries))) AS entry_no FROM log l WHERE txn_state = 'Prepare' AND ns_name <> 'main' AND entry_type IN ('KV', 'Row', 'Chunked')
  AND NOT EXISTS (SELECT 1 FROM log c WHERE c.txn_state = 'Commit' AND c.ns_name = l.ns_name AND c.txn_id = l.txn_id))
SELECT ns_name, entry_type, count(*) AS n FROM lost GROUP BY ALL""",
    "envelopes": """WITH r AS (SELECT batch_id, unnest(range(len(records))) AS pos, unnest(records) AS r FROM stream_batches)
SELECT batch_id, pos, 7 AS term, r.lsn AS log_index, r.lsn % 3 = 0 AS is_placeholder, CASE WHEN r.lsn % 3 = 0 THEN r.lsn END AS lsn, CASE WHEN r.lsn % 3 = 0 THEN CASE WHEN batch_id = 0 THEN 1 ELSE batch_id * 1000 END END AS hlc,
  md5(CASE WHEN r.lsn % 3 = 0 THEN ''::BLOB ELSE coalesce(r.record, ''::BLOB) END) AS md5 FROM r WHERE r.lsn IS NOT NULL""",
    "renumbered_records": LOG + " SELECT ns_name, operation_type, entry_type, count(*) AS n, count(*) AS n_renumbered, CAST(sum(coalesce(len(entries), 0)) AS BIGINT) AS n_entries FROM log GROUP BY ALL",
    "checkpoints": """SELECT ns_name, max(lsn) AS records, arg_max(segment_id, lsn) AS segment_id, arg_max(seg_offset, lsn) AS seg_offset, max(lsn) + 5 AS raft_index, 3 AS raft_term, 0 AS short_index, true AS same, 36 AS size FROM log_records GROUP BY ALL""",
    "record_positions": "SELECT DISTINCT segment_id, seg_offset, " + OFFSET_BYTES.format("segment_id") + " || " + OFFSET_BYTES.format("seg_offset") + " || '00000000' AS position_hex, 'SegmentID=' || segment_id || ', Offset=' || seg_offset AS position, false AS is_zero FROM log_records",
    "stored_keys": """SELECT DISTINCT hex(put_key) AS key_hex, CASE WHEN hex(put_key)[1:2] = 'FD' THEN hex(put_key) ELSE 'FD' || printf('%08X', octet_length(put_key)) || hex(put_key) END || hex('c1') AS cell_hex, true AS typed_row_stays,
  'FF' || printf('%08X', octet_length(put_key)) || hex(put_key) || '00000002' AS chunk_hex, true AS typed_chunk_stays, true AS typed_kv_stays, 'FC' || hex('wal.checkpoint') AS system_hex, 'System' AS system_kind
FROM put_requests WHERE put_key IS NOT NULL""",
    "size_texts": """SELECT p_partkey, p_size * CASE p_partkey % 5 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS bytes, 3 AS n_list,
  CASE WHEN p_partkey = 0 OR p_size = 0 THEN -1 ELSE p_size + p_partkey END AS sum_sizes, greatest(least(p_partkey - 50, 100), 0) AS clamped,
  CASE WHEN c >= 1000000000 THEN format('{:,.1f}', c / 1000000000) || 'G' WHEN c >= 1000000 THEN format('{:,.1f}', c / 1000000) || 'M' WHEN c >= 1000 THEN format('{:,.1f}', c / 1000) || 'K' ELSE c::VARCHAR END AS si,
  format('{:,}', p_partkey * 12345) AS commas, """
    + DECIMALS.format("(p_retailprice / 7)")
    + """ AS latency, (p_partkey + 7) // 8 * 8 AS aligned, greatest((length(bin(p_partkey * p_partkey)) + 6) // 7, 1) AS varint FROM (SELECT *, p_partkey * p_partkey * p_partkey AS c FROM part)""",
    "name_texts": """SELECT c_custkey, c_mktsegment AS service, c_name AS method, printf('%09d', c_custkey) || '.seg' AS file_name, c_mktsegment || '-' || c_nationkey || '-' || c_custkey AS bench_key, c_mktsegment AS package, 'unknown' AS no_package,
  'm.' || replace(replace(c_mktsegment, ' ', '_'), ':', '_') || '.a_b_c' AS metric, 'root/' || c_mktsegment || '/' || c_name AS path, c_custkey % 3 = 2 AS is_relative, sha256(c_name || '||' || c_mktsegment) AS hash,
  CASE c_custkey % 4 WHEN 0 THEN 'first' WHEN 3 THEN 'last' ELSE 'middle' END AS label, CASE c_custkey % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'WARN' WHEN 2 THEN 'INFO' END AS level FROM customer""",
    "time_texts": f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, '-' AS none, epoch_us(ts) // 1000 AS hlc, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) END AS safe_us, {DURATION} AS duration
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id * 37 ELSE event_id % 60 END AS s FROM events)""",
    "error_texts": """SELECT * FROM (VALUES
('LSN not yet available', 'Unavailable', 'LSN not yet available', 'transient', 'committed', 409), ('LSN truncated', 'OutOfRange', 'LSN truncated', 'permanent', 'not_found', 404),
('missing required parameter: namespace', 'InvalidArgument', 'missing required parameter: namespace', 'permanent', 'read_only', 403),
('namespace is not found on the current server', 'NotFound', 'namespace is not found on the current server', 'permanent', 'unsupported_type', 400), ('bad metadata in request', 'InvalidArgument', 'bad metadata in request', 'permanent', 'no_columns', 400),
('missing required metadata: x-namespace', 'InvalidArgument', 'missing required metadata: x-namespace', 'permanent', 'key_changed', 400),
('stream timeout: no records received within dynamic threshold seconds', 'Unavailable', 'stream timeout: no records received within dynamic threshold seconds', 'transient', 'aborted', 410),
('invalid sequence: StartMarker must be sent before sending chunks or calling CommitMarker', 'FailedPrecondition', 'invalid sequence: StartMarker must be sent before sending chunks or calling CommitMarker', 'permanent', 'other', 500),
('invalid checksum: checksum mismatch', 'DataLoss', 'invalid checksum: checksum mismatch', 'permanent', NULL, 500), ('put chunk stream already commited', 'Aborted', 'put chunk stream already commited', 'permanent', NULL, 500),
('boom', 'Internal', 'internal server error', 'transient', NULL, 500), ('permission denied', 'Internal', 'internal server error', 'permanent', NULL, 500)) t(error, code, told, kind, problem, http)""",
    "backoffs": "SELECT event_id % 12 AS attempt, count(*) AS n, true AS is_within FROM events GROUP BY ALL",
    "sampled_levels": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL",
    "slow_operations": "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL",
    "io_share": "SELECT round(sum(l_linenumber) / (sum(l_linenumber) + sum(l_quantity)) * 100, 6) AS percent FROM lineitem",
    "bench_csv": "SELECT event_type AS test, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS rps, round(sum(value), 4) AS p50_ms FROM events WHERE event_id % 7 <> 0 GROUP BY ALL",
    "gc_trace_lines": f"WITH {GC} SELECT cycle, at_s, round(pause_ms, 1) AS pause_ms, concurrent_ms, 4 AS heap_before, user_id AS heap_after, 9 AS goal_mb FROM g",
    "gc_trace_summary": f"WITH {GC} SELECT count(*) AS n, round(max(at_s) - min(at_s), 4) AS span_s, round(avg(round(pause_ms, 1)), 4) AS mean_ms, round(quantile_cont(round(pause_ms, 1), 0.95), 4) AS p95_ms FROM g",
    "bench_results": """SELECT 'Put/' || replace(p_name, ' ', '_') AS name, CAST(sum(p_partkey + 1) AS BIGINT) AS n, sum(p_size + 0.5)::DOUBLE AS ns_per_op, (12.25 * nullif(count(*) FILTER (p_partkey % 2 = 0), 0))::DOUBLE AS mb_per_s FROM part GROUP BY ALL""",
    "relayer_blocks": "SELECT r_name AS heading, n_name AS sample FROM nation JOIN region ON n_regionkey = r_regionkey",
    "load_means": "SELECT user_id % 4 AS relayers, event_type AS op, round(avg(event_id), 4) AS rps, round(avg(value), 4) AS latency_ms FROM events GROUP BY ALL",
    "chunk_means": "SELECT split_part(p_name, ' ', 1) || '/' || lower(p_type) AS mode, p_size <= 16 AS is_small, round(avg(p_partkey * 1000) / 1e6, 6) AS mean_ms FROM part GROUP BY ALL",
    "made_pools": "SELECT * FROM (VALUES ('keys', 500, true), ('values', 2000, true), ('picks', 3000, true), ('mutated', 500, true), ('operations', 10000, true)) t(pool, n, is_right)",
    "report_segments": f"""WITH c AS (SELECT row_number() OVER (ORDER BY segment_id) AS line_no, printf('%08d', segment_id) AS a, status AS b, format('{{:,}}', write_offset) AS c, format('{{:,}}', entry_count) AS d, format('{{:,}}', first_log_index) AS e,
  strftime(last_modified_at, '%Y-%m-%dT%H:%M:%SZ') AS f FROM ({LIST}) WHERE ns_name = 'main'
UNION ALL SELECT 0, 'ID', 'STATUS', 'SIZE', 'ENTRIES', 'FIRST_INDEX', 'LAST_MODIFIED'),
w AS (SELECT max(length(a)) + 2 AS a, max(length(b)) + 2 AS b, max(length(c)) + 2 AS c, max(length(d)) + 2 AS d, max(length(e)) + 2 AS e FROM c)
SELECT c.line_no, rpad(c.a, w.a::INT, ' ') || rpad(c.b, w.b::INT, ' ') || rpad(c.c, w.c::INT, ' ') || rpad(c.d, w.d::INT, ' ') || rpad(c.e, w.e::INT, ' ') || c.f AS line FROM c, w""",
    "report_totals": f"""WITH t AS (SELECT count(*) AS n, count(*) FILTER (status = 'sealed') AS s, count(*) FILTER (status = 'active') AS a, sum(entry_count)::BIGINT AS e, sum(write_offset)::BIGINT AS b FROM ({LIST}) WHERE ns_name = 'main')
SELECT 1 AS line_no, rpad('Total Segments:', 19, ' ') || n AS line FROM t UNION ALL SELECT 2, rpad('  Sealed:', 19, ' ') || s FROM t UNION ALL SELECT 3, rpad('  Active:', 19, ' ') || a FROM t
UNION ALL SELECT 4, rpad('Total Entries:', 19, ' ') || format('{{:,}}', e) FROM t UNION ALL SELECT 5, rpad('Total Size:', 19, ' ') || format('{{:,}}', b) FROM t""",
    "report_csv": """SELECT 'event_type,note,most,total_ops' AS line UNION ALL SELECT event_type || ',"a ""b"", c",' || printf('%.2f', max(value)) || ',' || count(*) FROM events GROUP BY event_type""",
    "report_json": f"""SELECT '{{"ns_name":"' || ns_name || '","segment_id":' || segment_id || ',"status":"' || status || '","entry_count":' || entry_count || '}}' AS line FROM ({LIST})""",
    "namespaces_sorted": "SELECT string_agg(ns_name, ',' ORDER BY ns_name) AS namespaces FROM (SELECT DISTINCT ns_name FROM log_records)",
    "log_object_checks": EFFECTIVE
    + """, c AS (SELECT ns_name, k, commit_lsn, count(*) AS n FROM eff WHERE entry_type = 'Chunked' GROUP BY ALL), newest AS (SELECT ns_name, k, max(commit_lsn) AS commit_lsn FROM c GROUP BY ALL)
SELECT ns_name, hex(k) AS entry_key, n AS n_chunks, n AS n_expected, true AS is_complete FROM c JOIN newest USING (ns_name, k, commit_lsn)""",
}
