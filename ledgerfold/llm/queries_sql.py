"""SQL counterparts of the queries in queries.py. p6 has none: its tests compare it with the public libraries."""

P8_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t\r\n]+'), lambda x: x <> '') AS words,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines,
    length(regexp_replace(t, '[ \t\r\n]', '', 'g')) AS n_chars,
    length(regexp_replace(t, '[^!-/:-@\[-`{-~]', '', 'g')) AS n_symbols
  FROM d
), common AS (SELECT list(DISTINCT word) AS cw FROM common_words),
n AS (
  SELECT doc_id, n_chars, n_symbols, len(words) AS n_words,
    len(list_filter(words, lambda x: list_contains(cw, regexp_replace(regexp_replace(lower(x), '^[^a-z]+', ''), '[^a-z]+$', '')))) AS n_common,
    len(lines) AS n_lines, len(list_filter(lines, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ended
  FROM w, common
), stats AS (
  SELECT *, n_words >= 40 AND n_words >= 4 * n_lines AND n_common * 10 >= 3 * n_words
    AND (n_chars BETWEEN 3 * n_words AND 7 * n_words)::INT + (n_symbols * 10 <= n_chars)::INT + (n_ended * 2 >= n_lines)::INT >= 2 AS is_prose
  FROM n
)
"""

P8_FOUND = P8_COUNTS + "SELECT doc_id FROM stats WHERE is_prose"

P8_STATS = (
    P8_COUNTS
    + """
SELECT doc_id, n_chars, n_symbols, n_words, n_common, n_lines, n_ended,
  round(n_chars / nullif(n_words, 0), 6) AS mean_word_length, round(n_words / nullif(n_lines, 0), 6) AS words_per_line,
  round(n_symbols / nullif(n_chars, 0), 6) AS symbol_ratio, round(n_ended / nullif(n_lines, 0), 6) AS ended_ratio,
  round(n_common / nullif(n_words, 0), 6) AS common_ratio, is_prose
FROM stats
"""
)

#: The 13 words from each word on; null where fewer are left.
STRETCH = "w || " + " || ".join(f"' ' || lead(w, {k}) OVER o" for k in range(1, 13))

P7_FOUND = f"""
WITH d AS (
  SELECT doc_id, unnest(range(len(ws))) AS i, lower(unnest(ws)) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM documents)
), p AS (
  SELECT item_id, unnest(range(len(ws))) AS i, lower(unnest(ws)) AS w FROM (SELECT item_id, regexp_extract_all(passage, '[A-Za-z0-9]+') AS ws FROM eval_items)
), dw AS (SELECT doc_id, {STRETCH} AS s FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), pw AS (SELECT item_id, {STRETCH} AS s FROM p WINDOW o AS (PARTITION BY item_id ORDER BY i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN pw USING (s)
"""

SQL = {"p7_found": P7_FOUND, "p8_found": P8_FOUND, "p8_stats": P8_STATS}
