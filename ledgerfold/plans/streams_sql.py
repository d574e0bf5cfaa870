"""SQL counterparts of the queries in streams.py: what the same data gives at once."""

from .general_sql import P1_FOUND
from .reference_sql import EFFECTIVE

SQL = {
    "stream_kv_latest": """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""",
    "stream_log_state": P1_FOUND,
    "stream_objects": """SELECT ns_name, lsn // 1024 AS stretch, count(DISTINCT lsn) AS n_records, max(lsn) AS last_lsn FROM log_records GROUP BY ALL""",
    "stream_notifications": EFFECTIVE
    + """, m AS (SELECT DISTINCT ns_name || '.' || CASE entry_type WHEN 'KV' THEN 'kv' WHEN 'Row' THEN 'row' ELSE 'lob' END AS topic,
  CASE op WHEN 'Insert' THEN 'put' WHEN 'Delete' THEN 'delete' ELSE 'delete_row' END AS operation, k, commit_lsn FROM eff WHERE entry_type <> 'Row' OR op = 'DeleteRowByKey' OR cardinality(cells) > 0)
SELECT topic, operation, count(*) AS n FROM m GROUP BY ALL""",
    "stream_hours": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    # in one batch the watermark stands an hour behind the newest arrival when the timers are looked at
    "stream_aborts": """WITH t AS (SELECT ns_name, txn_id, min(lsn) AS first_lsn, count(DISTINCT lsn) AS n_records, least(epoch_us(max(ingested_at)) // 1000 + 120000, epoch_us(min(ingested_at)) // 1000 + 900000) AS due
  FROM log_records WHERE txn_id IS NOT NULL GROUP BY ALL HAVING NOT bool_or(txn_state = 'Commit'))
SELECT ns_name, hex(txn_id) AS txn_id, first_lsn, n_records FROM t WHERE due < (SELECT epoch_us(max(ingested_at) FILTER (txn_id IS NOT NULL)) // 1000 - 3600000 FROM log_records)""",
}
