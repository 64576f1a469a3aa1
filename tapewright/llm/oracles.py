"""DuckDB SQL for the queries that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS gram FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 4)) AS i)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
), e AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words AS symbol_heavy, 10 * n_dup_lines > 3 * n_lines AS line_heavy FROM f
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x
  FROM (SELECT source, unnest(['base', 'symbol', 'line']) AS rule, unnest([base_failed, symbol_heavy, line_heavy]) AS failed FROM e) GROUP BY ALL
), t AS (
  SELECT rule, sum(n) AS n_all, count(*) AS h_all, sum(x) / sum(n) AS m, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)), 0) AS s FROM h GROUP BY rule
), p AS (
  SELECT rule, m, 1 / least(greatest(CASE WHEN m * (1 - m) > 0 AND h_all < n_all THEN (s - m * (1 - m) * h_all / n_all) / (m * (1 - m) * (1 - h_all / n_all)) ELSE 1e-6 END, 1e-6), 1.0) - 1 AS size FROM t
), v AS (
  SELECT source, bool_or((x + size * m) / (n + size) > 0.5) AS host_rejected FROM h JOIN p USING (rule) GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM e JOIN v ON e.source IS NOT DISTINCT FROM v.source
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), o AS (
  SELECT '' AS filter_order, 0 AS step, '' AS filter, 0 AS filter_bit, 0 AS before, 0 AS used
  UNION ALL
  SELECT filter_order || x.filter, step + 1, x.filter, x.bit, used, used | x.bit
  FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([1, 2, 4, 8, 16]) AS bit) AS x WHERE used & x.bit = 0
), orders AS (
  SELECT filter_order FROM o WHERE step = 5
), s AS (
  SELECT orders.filter_order, o.step, o.filter, o.filter_bit, o.before FROM orders JOIN o ON o.step > 0 AND o.filter_order = left(orders.filter_order, o.step)
), r AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN fails & (before | filter_bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & filter_bit != 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before != 0 AND fails & filter_bit != 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = filter_bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & filter_bit != 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & filter_bit != 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s, c GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
