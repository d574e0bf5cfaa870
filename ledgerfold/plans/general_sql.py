"""SQL counterparts of the queries in general.py, for DuckDB over the same tables."""

P1_FOUND = """
WITH log AS (
  SELECT DISTINCT ON (ns_name, lsn) ns_name, lsn, operation_type AS op, txn_state, entry_type, txn_id, entries FROM log_records
), done AS (
  SELECT ns_name, txn_id, min(lsn) AS commit_lsn, arg_min(op, lsn) AS op FROM log WHERE txn_state = 'Commit' GROUP BY ALL
), rec AS (
  SELECT ns_name, entry_type, op, lsn AS commit_lsn, lsn, entries FROM log
  WHERE txn_state = 'None' AND entry_type IN ('KV', 'Row') AND op IN ('Insert', 'Delete', 'DeleteRowByKey')
  UNION ALL
  SELECT l.ns_name, l.entry_type, d.op, d.commit_lsn, l.lsn, l.entries FROM log l
  JOIN done d ON d.ns_name = l.ns_name AND d.txn_id = l.txn_id AND l.lsn < d.commit_lsn WHERE l.txn_state = 'Prepare'
), ent AS (
  SELECT ns_name, entry_type, op, commit_lsn, lsn, unnest(range(len(entries))) AS entry_no, unnest(entries) AS e FROM rec
), one AS (
  SELECT ns_name, entry_type, op, e.entry_key AS k, e.cells AS cells, lsn, entry_no, (commit_lsn, lsn, entry_no) AS ord
  FROM ent WHERE e.entry_key IS NOT NULL
), kv AS (
  SELECT ns_name, entry_type, k, '' AS cell_name, max(ord) AS o, arg_max(op, ord) AS op FROM one WHERE entry_type = 'KV' GROUP BY ALL
), bar AS (
  SELECT ns_name, k, max(ord) AS bar FROM one WHERE entry_type = 'Row' AND op = 'DeleteRowByKey' GROUP BY ALL
), cell AS (
  SELECT ns_name, entry_type, k, unnest(map_keys(cells)) AS cell_name, ord, op FROM one WHERE entry_type = 'Row' AND op IN ('Insert', 'Delete')
), row_cells AS (
  SELECT ns_name, entry_type, k, cell_name, max(ord) AS o, arg_max(op, ord) AS op FROM cell GROUP BY ALL
), objects AS (
  SELECT ns_name, entry_type, k, '' AS cell_name, max(ord) AS o, arg_max(op, ord) AS op FROM one WHERE entry_type = 'Chunked' GROUP BY ALL
), live AS (
  SELECT ns_name, entry_type, k, cell_name, o FROM kv WHERE op = 'Insert'
  UNION ALL
  SELECT c.ns_name, c.entry_type, c.k, c.cell_name, c.o FROM row_cells c LEFT JOIN bar b ON b.ns_name = c.ns_name AND b.k = c.k
  WHERE c.op = 'Insert' AND (b.bar IS NULL OR c.o > b.bar)
  UNION ALL
  SELECT ns_name, entry_type, k, cell_name, o FROM objects WHERE op = 'Insert'
)
SELECT ns_name, entry_type, hex(k) AS key_hex, cell_name, o[2] AS lsn, o[3] AS entry_no FROM live
"""

KEY_ROWS = """
WITH puts AS (
  SELECT 'put_requests' AS rec_kind, ns_name, put_key AS key, put_value AS value, row_number() OVER () AS pos, 0 AS entry_no FROM put_requests
), log AS (
  SELECT ns_name, entries, row_number() OVER () AS pos FROM log_records
), elements AS (
  SELECT ns_name, pos, unnest(range(len(entries))) AS entry_no, unnest(entries) AS e FROM log
), rows_of AS (
  SELECT rec_kind, ns_name, key, value, pos, entry_no FROM puts
  UNION ALL
  SELECT 'log_records', ns_name, e.entry_key, e.entry_value, pos, entry_no FROM elements
)
"""

P2_FOUND = (
    KEY_ROWS
    + """
, counts AS (SELECT rec_kind, ns_name, key, count(*) AS n FROM rows_of GROUP BY ALL),
totals AS (SELECT rec_kind, count(*) AS total FROM rows_of GROUP BY ALL)
SELECT rec_kind, ns_name, hex(key) AS key_hex FROM counts JOIN totals USING (rec_kind) WHERE key IS NOT NULL AND n * 50 >= total
"""
)

P2_KEYS = (
    KEY_ROWS
    + """
, steps AS (
  SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS prev FROM rows_of
  WINDOW w AS (PARTITION BY rec_kind, ns_name, key ORDER BY pos, entry_no)
)
SELECT rec_kind, ns_name, hex(key) AS key_hex, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls,
  count(*) FILTER (rn > 1 AND value IS DISTINCT FROM prev) AS changes
FROM steps GROUP BY rec_kind, ns_name, key
"""
)

P3_SIDES = """
WITH a AS (SELECT DISTINCT ns_name, put_key, put_value, put_ts, crc32_checksum, true AS here FROM primary_kv),
b AS (SELECT DISTINCT ns_name, put_key, put_value, put_ts, crc32_checksum, true AS here FROM replica_kv),
j AS (
  SELECT coalesce(a.ns_name, b.ns_name) AS ns_name, coalesce(a.put_key, b.put_key) AS k, a.here AS in_a, b.here AS in_b,
    a.put_value AS av, b.put_value AS bv, a.put_ts AS at_, b.put_ts AS bt, a.crc32_checksum AS ac, b.crc32_checksum AS bc
  FROM a FULL JOIN b ON a.ns_name IS NOT DISTINCT FROM b.ns_name AND a.put_key IS NOT DISTINCT FROM b.put_key
)
"""

P3_FOUND = (
    P3_SIDES
    + """
SELECT ns_name, hex(k) AS key_hex, 'missing_in_primary' AS diff_field FROM j WHERE in_a IS NULL
UNION ALL SELECT ns_name, hex(k), 'missing_in_replica' FROM j WHERE in_b IS NULL
UNION ALL SELECT ns_name, hex(k), 'put_value' FROM j WHERE in_a AND in_b AND av IS DISTINCT FROM bv
UNION ALL SELECT ns_name, hex(k), 'put_ts' FROM j WHERE in_a AND in_b AND at_ IS DISTINCT FROM bt
UNION ALL SELECT ns_name, hex(k), 'crc32_checksum' FROM j WHERE in_a AND in_b AND ac IS DISTINCT FROM bc
"""
)

P3_VALUES = (
    P3_SIDES
    + """
SELECT ns_name, hex(k) AS key_hex, 'put_value' AS diff_field, hex(av) AS left_value, hex(bv) AS right_value
FROM j WHERE in_a AND in_b AND av IS DISTINCT FROM bv
UNION ALL SELECT ns_name, hex(k), 'put_ts', CAST(at_ AS VARCHAR), CAST(bt AS VARCHAR) FROM j WHERE in_a AND in_b AND at_ IS DISTINCT FROM bt
UNION ALL SELECT ns_name, hex(k), 'crc32_checksum', CAST(ac AS VARCHAR), CAST(bc AS VARCHAR)
FROM j WHERE in_a AND in_b AND ac IS DISTINCT FROM bc
"""
)

P4_FOUND = """
WITH held AS (SELECT ns_name, min(lsn) AS first_lsn FROM log_records GROUP BY ALL),
lsns AS (SELECT DISTINCT ns_name, lsn FROM log_records),
req AS (
  SELECT r.consumer_id, r.ns_name, coalesce(r.start_lsn, h.first_lsn) AS lo, r.latest_lsn AS hi, r.outcome
  FROM (SELECT DISTINCT consumer_id, ns_name, start_lsn, latest_lsn, outcome FROM stream_requests) r JOIN held h USING (ns_name)
), span AS (SELECT consumer_id, ns_name, min(lo) AS lo, max(hi) AS hi FROM req GROUP BY ALL)
SELECT s.consumer_id, s.ns_name, l.lsn FROM span s JOIN lsns l ON l.ns_name = s.ns_name AND l.lsn BETWEEN s.lo AND s.hi
WHERE NOT EXISTS (
  SELECT 1 FROM req q WHERE q.outcome = 'ok' AND q.consumer_id = s.consumer_id AND q.ns_name = s.ns_name AND l.lsn BETWEEN q.lo AND q.hi
)
"""

#: DuckDB has no CRC-32, so P5 works it out bit by bit: the table of 256 values, then a fold over each record's bytes.
P5_FOUND = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
flat AS (
  SELECT batch_id, consumer_id, ns_name, unnest(range(len(records))) AS rec_pos, unnest(records) AS r FROM stream_batches
), copies AS (
  SELECT batch_id, rec_pos, consumer_id, ns_name, r.lsn AS lsn,
    r.crc32_checksum IS NOT NULL AND r.crc32_checksum IS DISTINCT FROM CASE WHEN r.record IS NOT NULL THEN xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(octet_length(r.record)), lambda i: ('0x' || substr(hex(r.record), 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) END AS bad
  FROM flat, crc WHERE r.lsn IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY consumer_id, ns_name, lsn ORDER BY bad, batch_id, rec_pos) AS rn FROM copies
)
SELECT batch_id, rec_pos FROM ranked WHERE rn > 1
"""

SQL = {
    "p1_found": P1_FOUND,
    "p2_found": P2_FOUND,
    "p2_keys": P2_KEYS,
    "p3_found": P3_FOUND,
    "p3_values": P3_VALUES,
    "p4_found": P4_FOUND,
    "p5_found": P5_FOUND,
}
