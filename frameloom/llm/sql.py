"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A word of a benchmark or document text: lower-case A-Z, digits and characters beyond ASCII.
_TERMS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP2 = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
windows AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
grams AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM windows),
often AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, range(8) r(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, t, w, ls, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
  FROM d LEFT JOIN hit USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
        len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_adjacent FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 1.5 * n_words AND 25.0 * n_words AND n_symbols <= 0.25 * n_words AND n_upper <= 0.5 * n_words
       AND n_adjacent <= 0.3 * n_words AND n_dup_lines <= 0.5 * len(ls) AS kept
FROM v
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT item_id, w[s+1:s+10] AS g, len(w[s+1:s+10]) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, w, unnest(range(0, len(w))) AS p FROM d),
occ AS (SELECT rid, p, sizes.n AS n, w[p+1:p+sizes.n] AS g FROM dw, sizes WHERE p + sizes.n <= len(w)),
m AS (SELECT DISTINCT rid, p, win.n AS n, item_id FROM occ JOIN win ON occ.g = win.g AND occ.n = win.n),
hit AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM m, range(10) r(k) WHERE k < n GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE_SQL = {"op2_quality_rules": OP2, "op8_decontamination": OP8}
