"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
m AS (
  SELECT doc_id, text, words, lines, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_lettered,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*([-*+]\s|\x{2022})'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})\s*$'))) AS n_ellipses
  FROM w),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS window3
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3)),
repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, window3) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
j AS (
  SELECT m.*, coalesce(c.n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 10 * n_words
    OR 100 * n_dup_lines > 60 * len(lines)
    OR 100 * (n_words - n_lettered) > 20 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_bullets > 90 * len(lines)
    OR 100 * n_ellipses > 30 * len(lines)) AS kept
FROM j
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
repeats AS (
  SELECT doc_id, i FROM windows
  QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM repeats),
held AS (
  SELECT doc_id, w[p] AS word, p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
  ANTI JOIN gone USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM held GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_TOKENS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_OP4 = r"""
WITH d AS (SELECT doc_id, TOKENS AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, TOKENS AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, i, n FROM places JOIN windows USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
"""
OP4 = _OP4.replace("TOKENS", _TOKENS) + """
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|<\|im_start\|>|<\|im_next\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1.', 'g')) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN role = before THEN 11 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10 = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages),
asked AS (
  SELECT DISTINCT host, array_to_string(l[i:], '.') AS key
  FROM (SELECT host, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i
        FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM captures WHERE host IS NOT NULL))),
h AS (
  SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS h0, ('0x' || substr(md5(key), 5, 4))::INT AS h1,
    ('0x' || substr(md5(key), 9, 4))::INT AS h2, ('0x' || substr(md5(key), 13, 4))::INT AS h3,
    ('0x' || substr(md5(key), 17, 4))::INT AS h4
  FROM (SELECT DISTINCT key FROM asked)),
listed AS (
  SELECT key, ['ads', 'adult', 'malware'][h0 % 3 + 1] AS list, DATE '2024-01-01' + h1 % 200 AS a,
    CASE WHEN h3 % 4 > 0 THEN DATE '2024-01-01' + (h1 % 200 + h2 % 120 + 1) END AS r,
    CASE WHEN h4 % 2 > 0 THEN DATE '2024-01-01' + (h1 % 200 + h2 % 120 + 41) END AS a2
  FROM h WHERE h0 % 10 < 4),
hits AS (
  SELECT page_id, string_agg(list || ':' || key, ',' ORDER BY list || ':' || key) AS blocked_by
  FROM captures JOIN asked USING (host) JOIN listed USING (key)
  WHERE (fetched >= a AND (r IS NULL OR fetched < r)) OR fetched >= a2
  GROUP BY page_id)
SELECT page_id, url, fetched::VARCHAR AS fetched, coalesce(blocked_by, '') AS blocked_by,
  blocked_by IS NOT NULL AS blocked
FROM captures LEFT JOIN hits USING (page_id)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, TERMS AS w FROM documents),
size AS (
  SELECT count(*) FILTER (len(w) > 0) AS documents, sum(len(w))::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(TERMS) AS term FROM benchmark),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  SEMI JOIN q USING (term) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
score AS (
  SELECT item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))))::BIGINT AS score
  FROM tf JOIN weight USING (term) JOIN q USING (term), size
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("TERMS", r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')""")

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS in_lang FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, in_lang, coalesce(n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
    1 + (1000000000::HUGEINT * (in_lang + 5)) // (sum(in_lang) OVER w + 5 * count(*) OVER w) AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON (x.lang, x.source, x.item) = (a.lang, a.source, b.source)),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
  FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {
    "op2_substring_dedup": OP2,
    "op4_decontamination": OP4,
    "op6_chat_formatting": OP6,
    "op8_quality_rules": OP8,
    "op10_url_filters": OP10,
    "op11_lexical_search": OP11,
    "op13_source_divergence": OP13,
}
