"""SQL for the driver's comparison, written for DuckDB over the same tables.

The statements work from the definitions, on their own: no text is shared with the
Spark side beyond column names.
"""

from __future__ import annotations

from itertools import combinations

# events with a skewed, partly null key.
HOT = """hot AS (
  SELECT *, CASE WHEN event_id % 20 = 0 THEN NULL
                 WHEN event_id % 5 < 2 THEN 0 ELSE user_id END AS hot_key
  FROM events)"""

HOT_LONG = HOT + """, long AS (
  SELECT 'hot_key' AS col, CAST(hot_key AS VARCHAR) AS key FROM hot
  UNION ALL SELECT 'event_type', event_type FROM hot)"""


def _long(table: str, *columns: str) -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS key FROM {table}" for c in columns
    ) + ")"


FREQ = "freq AS (SELECT col, key, count(*) AS n FROM long GROUP BY col, key)"

TOP = """top AS (
  SELECT * FROM (
    SELECT col, key, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, key) AS rnk
    FROM freq WHERE key IS NOT NULL)
  WHERE rnk <= 20)"""

SHAPE = """shape AS (
  SELECT col, count(*) AS nk, sum(n) AS top_rows, max(n) AS max_n, avg(n) AS mean_n,
    max(n) / avg(n) AS skew,
    greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS nats,
    string_agg(key, ',' ORDER BY rnk) AS keys,
    string_agg(CAST(n AS VARCHAR), ',' ORDER BY rnk) AS counts
  FROM top GROUP BY col)"""

TOTALS = """totals AS (
  SELECT col, count(*) AS total, count(*) - count(key) AS nulls FROM long GROUP BY col)"""


DISTINCTS = """distincts AS (
  SELECT col, CAST(count(DISTINCT key) AS DOUBLE) AS estimate FROM long GROUP BY col)"""

# Of a stream's sketch: as many registers as 2^14.
SKETCH_ERROR = "1.04::DOUBLE / sqrt(16384)"

PROFILE_CTES = ", ".join([FREQ, TOP, SHAPE, TOTALS, DISTINCTS])


def _profile_select(batches: bool = True) -> str:
    error = "0.0::DOUBLE" if batches else SKETCH_ERROR
    batch = "CAST(ceil(t.total / 50000.0) AS BIGINT) AS batch_count," if batches else ""
    return f"""SELECT t.col AS "column", t.total AS total_rows,
  round(coalesce(d.estimate, 0), 6) AS cardinality_estimate, t.nulls AS null_count,
  round(t.nulls / t.total, 6) AS null_fraction, round(coalesce(s.skew, 1.0), 6) AS skew_ratio,
  coalesce(s.keys, '') AS top_keys, coalesce(s.counts, '') AS partition_counts, {batch}
  round({error}, 6) AS hll_error
FROM totals t LEFT JOIN shape s USING (col) LEFT JOIN distincts d USING (col)"""


SCORED = """scored AS (
  SELECT t.col, coalesce(s.skew, 1.0) AS skew, t.nulls / t.total AS nf,
    CASE WHEN s.nk > 1 THEN 100 * s.nats / ln(s.nk) ELSE 0 END AS ent,
    100 * (t.nulls / t.total) AS null_pen,
    100 * least(coalesce(s.skew, 1.0), 50) / 50 AS skew_pen
  FROM totals t LEFT JOIN shape s USING (col)),
composed AS (
  SELECT *, 0.4::DOUBLE * ent + 0.3::DOUBLE * (100 - null_pen) + 0.3::DOUBLE * (100 - skew_pen) AS c
  FROM scored),
judged AS (
  SELECT *, CASE WHEN c >= 75 THEN 'good'
      WHEN c >= 50 AND (skew > 10 OR nf > 0.1) THEN 'warning'
      WHEN c >= 50 THEN 'info' WHEN c >= 25 THEN 'danger' ELSE 'critical' END AS severity,
    CASE WHEN c >= 75 THEN 'Good partition key candidate'
      WHEN c >= 50 AND skew > 10 THEN 'Moderate skew — consider salting or composite key'
      WHEN c >= 50 AND nf > 0.1 THEN 'High null rate — add NOT NULL filter or composite key'
      WHEN c >= 50 THEN 'Acceptable partition key'
      WHEN c >= 25 THEN 'High skew — salting recommended before production use'
      ELSE 'Severely skewed or sparse — repartition required' END AS recommendation
  FROM composed)"""

SCORE_CTES = ", ".join([FREQ, TOP, SHAPE, TOTALS, SCORED])

SCORES = """SELECT col AS "column", round(c, 1) AS composite_score, round(ent, 1) AS entropy_score,
  round(null_pen, 1) AS null_penalty, round(skew_pen, 1) AS skew_penalty,
  recommendation, severity FROM judged"""


def _cell(key: str, row: int, width: int) -> str:
    """A row's 32 bits of the key's digest; the sketches here have at most eight rows."""
    return f"CAST(('0x' || substr(sha256({key}), {8 * row + 1}, 8))::BIGINT % {width} AS INT)"


def _cells(width: int, depth: int, source: str = "freq", name: str = "cells") -> str:
    rows = " UNION ALL ".join(
        f"SELECT col, {i} AS \"row\", {_cell('key', i, width)} AS cell, n "
        f"FROM {source} WHERE key IS NOT NULL"
        for i in range(depth)
    )
    return (
        f"{name} AS (SELECT col, \"row\", cell, CAST(sum(n) AS BIGINT) AS cnt "
        f"FROM ({rows}) GROUP BY ALL)"
    )


CUSTKEY_ORDERS = """freq AS (
  SELECT 'custkey' AS col, CAST(o_custkey AS VARCHAR) AS key, count(*) AS n
  FROM orders GROUP BY o_custkey)"""
CUSTKEY_CUSTOMER = """probes AS (
  SELECT 'custkey' AS col, CAST(c_custkey AS VARCHAR) AS key, count(*) AS n
  FROM customer GROUP BY c_custkey)"""
CUSTKEY_BOTH = CUSTKEY_ORDERS + ", " + CUSTKEY_CUSTOMER + """, both_tables AS (
  SELECT * FROM freq UNION ALL SELECT * FROM probes)"""

LOADED = HOT + """, long AS (
  SELECT 'hot_key' AS col, CAST(hot_key AS VARCHAR) AS key FROM hot
  UNION ALL SELECT 'event_type', event_type FROM hot
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM hot)"""

BOUNDED = LOADED[:-1] + """
  UNION ALL SELECT 'hot_prop', CASE WHEN event_id % 20 = 0 THEN NULL
    WHEN event_id % 5 < 2 THEN 'none' ELSE props END FROM hot)"""

_32 = "4294967296"


def _times(x: str, factor: int) -> str:
    return f"(({x}) * {factor}::UBIGINT % {_32})"


def _turned(x: str, bits: int) -> str:
    """32 bits turned left."""
    return f"({_times(x, 1 << bits)} + ({x}) // {1 << (32 - bits)})"


def _byte(i: str) -> str:
    return f"('0x' || substr(hex(encode(key)), 2 * ({i}) - 1, 2))::BIGINT"


# The hash partition of a key among 8: MurmurHash3 in 32 bits with seed 42, over numbers as two
# words, over texts as little-endian words, then each byte left over as a signed word. Null leaves the seed.
SLOTS = f"""words AS (
  SELECT col, key, n, CASE WHEN col = 'event_type' THEN octet_length(encode(key)) ELSE 8 END AS size,
    CASE WHEN col = 'event_type' THEN list_concat(
      list_transform(range(1, octet_length(encode(key)) // 4 + 1), lambda i:
        {_byte('4 * i - 3')} + {_byte('4 * i - 2')} * 256 + {_byte('4 * i - 1')} * 65536 + {_byte('4 * i')} * 16777216),
      list_transform(range(octet_length(encode(key)) // 4 * 4 + 1, octet_length(encode(key)) + 1), lambda i:
        {_byte('i')} + CASE WHEN {_byte('i')} > 127 THEN 4294967040 ELSE 0 END))
    ELSE [TRY_CAST(key AS BIGINT) & 4294967295, (TRY_CAST(key AS BIGINT) >> 32) & 4294967295] END AS ws
  FROM freq),
mixed AS (
  SELECT col, key, n, xor(size::UBIGINT, list_reduce(
    list_prepend(42::UBIGINT, list_transform(ws::UBIGINT[], lambda w:
      {_times(_turned(_times('w', 0xCC9E2D51), 15), 0x1B873593)})),
    lambda h, k: ({_turned('xor(h, k)', 13)} * 5 + {0xE6546B64}) % {_32})) AS h
  FROM words),
mixed_2 AS (SELECT col, key, n, {_times('xor(h, h // 65536)', 0x85EBCA6B)} AS h FROM mixed),
mixed_3 AS (SELECT col, key, n, {_times('xor(h, h // 8192)', 0xC2B2AE35)} AS h FROM mixed_2),
slots AS (
  SELECT col, CAST(CASE WHEN key IS NULL THEN 42 ELSE xor(h, h // 65536) END % 8 AS INT) AS slot,
    CAST(sum(n) AS BIGINT) AS load
  FROM mixed_3 GROUP BY 1, 2)"""

ALL_SLOTS = """grid AS (
  SELECT c.col, CAST(i AS INT) AS slot, coalesce(s.load, 0) AS load
  FROM (SELECT DISTINCT col FROM slots) c CROSS JOIN range(8) AS r(i)
  LEFT JOIN slots s ON s.col = c.col AND s.slot = r.i),
busiest AS (
  SELECT col, CAST(sum(load) AS BIGINT) AS total, max(load) AS most,
    arg_min(slot, (-load, slot)) AS straggler
  FROM grid GROUP BY col),
hottest AS (SELECT col, max(n) AS hottest FROM freq GROUP BY col)"""


def _uniform(purpose: str) -> str:
    text = f"'42/{purpose}:' || CAST(event_id AS VARCHAR)"
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _ranks(name: str, purpose: str, n: int, exponent: float) -> str:
    """Per event the first of twelve draws that is taken."""
    e = f"(1 - {exponent}::DOUBLE)"
    integral = lambda x: f"((pow({x}, {e}) - 1) / {e})"
    inverse = lambda y: f"pow(1 + ({y}) * {e}, 1 / {e})"
    text = f"'42/{purpose}/' || i || ':' || CAST(event_id AS VARCHAR)"
    u = f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    last, first = integral(f"{n}.5::DOUBLE"), f"({integral('1.5::DOUBLE')} - 1)"
    sure = f"(2 - {inverse(integral('2.5::DOUBLE') + f' - pow(2::DOUBLE, -{exponent}::DOUBLE)')})"
    return f"""{name}_y AS (
  SELECT event_id, i, {last} + {u} * ({first} - {last}) AS y FROM events, range(12) AS r(i)),
{name}_x AS (SELECT *, {inverse('y')} AS x FROM {name}_y),
{name}_k AS (SELECT *, greatest(least(CAST(floor(x + 0.5) AS BIGINT), {n}), 1) AS k FROM {name}_x),
{name} AS (
  SELECT event_id, arg_min(k, i) AS rnk FROM {name}_k
  WHERE k - x <= {sure} OR y >= {integral('(k + 0.5::DOUBLE)')} - pow(k::DOUBLE, -{exponent}::DOUBLE)
  GROUP BY event_id)"""


ZIPF = f"""WITH drawn AS (
  SELECT event_id,
    {_uniform('null')} AS un, {_uniform('region')} AS ur, {_uniform('event_type')} AS ue,
    {_uniform('session')} AS us, {_uniform('timestamp')} AS ut
  FROM events),
{_ranks('users', 'user', 10000, 1.5)}, {_ranks('products', 'product', 5000, 1.1)}
SELECT d.event_id,
  CASE WHEN un >= 0.05 THEN 'user_' || (u.rnk - 1) END AS user_id,
  'prod_' || (p.rnk - 1) AS product_id,
  CASE WHEN ur < 0.35 THEN 'us-east-1' WHEN ur < 0.6 THEN 'us-west-2' WHEN ur < 0.8 THEN 'eu-west-1'
       WHEN ur < 0.9 THEN 'ap-southeast-1' WHEN ur < 0.97 THEN 'ap-northeast-1'
       ELSE 'sa-east-1' END AS region,
  CASE WHEN ue < 0.15 THEN 'purchase' WHEN ue < 0.55 THEN 'view' WHEN ue < 0.75 THEN 'add_to_cart'
       WHEN ue < 0.9 THEN 'search' WHEN ue < 0.97 THEN 'wishlist' ELSE 'review' END AS event_type,
  'sess_' || CAST(floor(us * 49999) + 1 AS BIGINT) AS session_id,
  CAST(1700000000 + floor(ut * 20000000) AS BIGINT) AS "timestamp"
FROM drawn d JOIN users u USING (event_id) JOIN products p USING (event_id)"""

# Every batch joined to all rows up to it, then profiled on its own.
SNAPSHOTS = """WITH LONG,
batches AS (SELECT DISTINCT b AS batch FROM long),
prefix AS (SELECT l.col, l.key, batch, count(*) AS n FROM batches JOIN long l ON l.b <= batch
  GROUP BY ALL),
totals AS (
  SELECT col, batch, sum(n) AS total, coalesce(sum(n) FILTER (key IS NULL), 0) AS nulls
  FROM prefix GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY col, batch ORDER BY n DESC, key) AS rnk
  FROM prefix WHERE key IS NOT NULL),
shape AS (
  SELECT col, batch, max(n) AS max_n, sum(n) AS top_rows, max(n) / avg(n) AS skew,
    string_agg(CAST(n AS VARCHAR), ',' ORDER BY rnk) AS counts
  FROM ranked WHERE rnk <= 20 GROUP BY ALL)
SELECT t.col AS "column", t.batch,
  CAST(row_number() OVER (PARTITION BY t.col ORDER BY t.batch) AS INT) AS batch_count,
  CAST(total AS BIGINT) AS total_rows, CAST(nulls AS BIGINT) AS null_count,
  round(skew, 6) AS skew_ratio, max_n AS max_count, CAST(top_rows AS BIGINT) AS top_rows,
  counts AS partition_counts
FROM totals t JOIN shape s USING (col, batch)"""
HOT_BATCHES = HOT + """, long AS (
  SELECT 'hot_key' AS col, CAST(hot_key AS VARCHAR) AS key, event_id // 1000 AS b FROM hot
  UNION ALL SELECT 'event_type', event_type, event_id // 1000 FROM hot)"""
UNIQUE_BATCHES = """long AS (
  SELECT 'event_id' AS col, CAST(event_id AS VARCHAR) AS key, event_id // 1000 AS b FROM events)"""

WHOLE = """whole AS (
  SELECT col, count(*) AS n_keys, max(n) / avg(n) AS whole_skew,
    greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS whole_nats
  FROM freq WHERE key IS NOT NULL GROUP BY col)"""
SHAPES = "WITH " + _long("lineitem", "l_orderkey", "l_shipdate") + f", {FREQ}, {TOP}, {SHAPE}, {WHOLE}"


def _within(source: str) -> str:
    return f"""SELECT col AS "column", count(DISTINCT key) AS distinct_keys, true AS within_bound
FROM {source} GROUP BY col"""

_KEY_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
_KEY_SETS = [s for n in (1, 2, 3) for s in combinations(range(4), n)]
SETS = "sets AS (" + " UNION ALL ".join(
    f"SELECT '{'|'.join(_KEY_COLUMNS[i] for i in s)}' AS columns, {len(s)} AS size, {list(s)} AS place, "
    f"max(n) AS hottest_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_KEY_COLUMNS[i] for i in s)})"
    for s in _KEY_SETS
) + ")"

_SALTED_KEY = "CAST(hot_key AS VARCHAR)"

ORACLES = {
    "parquet_scan": "SELECT * FROM lineitem",
    "schema_info": """SELECT (SELECT count(*) FROM lineitem) AS total_rows, column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS "type"
FROM (DESCRIBE lineitem)""",
    "csv_roundtrip": "SELECT * FROM orders",
    "arrow_roundtrip": "SELECT * FROM orders",
    "zipf_table": ZIPF,
    "partitioned_write": "SELECT event_type, event_id, user_id, value FROM events",
    "long_form": f'WITH {HOT_LONG} SELECT col AS "column", key FROM long',
    "key_frequency": "WITH "
    + _long("lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    + f', {FREQ} SELECT col AS "column", key, n FROM freq',
    "null_counts": f"""WITH {HOT_LONG}, {TOTALS}
SELECT col AS "column", total AS total_rows, nulls AS null_count,
  round(nulls / total, 6) AS null_fraction FROM totals""",
    "top_k_keys": "WITH "
    + _long("lineitem", "l_partkey", "l_suppkey")
    + f', {FREQ}, {TOP} SELECT col AS "column", key, n, CAST(rnk AS INT) AS rank FROM top',
    "approx_top_k": "WITH "
    + _long("lineitem", "l_partkey", "l_orderkey", "l_returnflag")
    + f', {FREQ}, {TOP} SELECT col AS "column", key, n, CAST(rnk AS INT) AS rank FROM top',
    "refined_top_k": """WITH long AS (
  SELECT 'l_partkey' AS col, CAST(l_partkey AS VARCHAR) AS key FROM lineitem
  UNION ALL SELECT 'l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'line', l_orderkey || '-' || l_linenumber FROM lineitem), """
    + f'{FREQ}, {TOP} SELECT col AS "column", key, n, CAST(rnk AS INT) AS rank FROM top',
    "footer_counts": f"""WITH {HOT}, long AS (
  SELECT 'hot_key' AS col, CAST(hot_key AS VARCHAR) AS key FROM hot
  UNION ALL SELECT 'event_type', event_type FROM hot UNION ALL SELECT 'ts', CAST(ts AS VARCHAR) FROM hot), {TOTALS}
SELECT col AS "column", total AS total_rows, nulls AS null_count,
  round(nulls / total, 6) AS null_fraction FROM totals""",
    "heavy_keys": f"""WITH {HOT} SELECT hot_key, count(*) AS n, (SELECT count(*) FROM hot) AS total
FROM hot GROUP BY hot_key HAVING count(*) * 25 > (SELECT count(*) FROM hot)""",
    "skew_ratio": SHAPES
    + """ SELECT col AS "column", max_n AS max_count, n_keys AS key_count,
  round(whole_skew, 6) AS skew_ratio, round(mean_n, 6) AS top_mean_count,
  round(skew, 6) AS top_skew_ratio FROM shape JOIN whole USING (col)""",
    "entropy": SHAPES
    + """ SELECT col AS "column", round(whole_nats, 6) AS entropy, round(nats, 6) AS top_entropy
FROM shape JOIN whole USING (col)""",
    "normalized_entropy": SHAPES
    + """ SELECT col AS "column", round(100 * whole_nats / ln(n_keys), 6) AS entropy_score,
  round(100 * nats / ln(nk), 6) AS top_entropy_score FROM shape JOIN whole USING (col)""",
    "column_profile": f"WITH {HOT_LONG}, {PROFILE_CTES} {_profile_select()}",
    "one_column_profile": f"WITH {HOT_LONG}, {PROFILE_CTES} {_profile_select()} "
    "WHERE t.col = 'hot_key'",
    "bounded_profile": "WITH "
    + _long("lineitem", "l_partkey", "l_orderkey", "l_returnflag")
    + f""", {PROFILE_CTES}, flat AS ({_profile_select()})
SELECT * EXCLUDE (cardinality_estimate, hll_error), true AS within_bound FROM flat""",
    "composite_key_profile": f"""WITH {HOT}, long AS (
  SELECT 'event_type|hot_key' AS col, CASE WHEN event_type IS NULL AND hot_key IS NULL THEN NULL
    ELSE coalesce(event_type, '\\N') || '|' || coalesce({_SALTED_KEY}, '\\N') END AS key FROM hot),
{PROFILE_CTES} {_profile_select()}""",
    "composite_key_search": f"""WITH {SETS}, judged AS (
  SELECT *, (SELECT count(*) FROM lineitem) AS total_rows,
    hottest_rows * 1000 <= (SELECT count(*) FROM lineitem) AS fits FROM sets)
SELECT columns, hottest_rows, total_rows, fits FROM judged
ORDER BY NOT fits, CASE WHEN fits THEN size ELSE hottest_rows END,
  CASE WHEN fits THEN hottest_rows ELSE size END, place LIMIT 1""",
    "not_null_profile": f"""WITH {HOT}, long AS (
  SELECT 'hot_key' AS col, {_SALTED_KEY} AS key FROM hot WHERE hot_key IS NOT NULL),
{PROFILE_CTES} {_profile_select()}""",
    "hll_registers": f"""WITH {HOT_LONG}, {TOTALS}, w AS ({_within('long')})
SELECT w.*, total AS total_rows, nulls AS null_count FROM w JOIN totals ON col = "column\"""",
    "hll_estimate": "WITH " + _long("lineitem", "l_partkey", "l_orderkey") + " " + _within("long"),
    "hll_merge": """SELECT 'custkey' AS "column", count(DISTINCT k) AS distinct_keys, true AS within_bound
FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)""",
    "hll_builtin": "WITH "
    + _long("lineitem", "l_orderkey", "l_partkey", "l_shipdate") + " " + _within("long"),
    "cms_cells": "WITH "
    + _long("lineitem", "l_partkey", "l_returnflag")
    + f', {FREQ}, {_cells(544, 5)} SELECT col AS "column", "row", cell, cnt FROM cells',
    "cms_weighted": f"""WITH freq AS (
  SELECT 'source' AS col, source AS key, sum(n_chars) AS n FROM documents GROUP BY source),
{_cells(544, 5)} SELECT col AS "column", "row", cell, cnt FROM cells""",
    "cms_total": """SELECT "column", count(*) AS total_count FROM (
  SELECT 'l_partkey' AS "column", CAST(l_partkey AS VARCHAR) AS key FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem)
WHERE key IS NOT NULL GROUP BY 1""",
    "cms_estimate": f"""WITH {CUSTKEY_ORDERS}, {CUSTKEY_CUSTOMER}, {_cells(544, 5)},
places AS ({" UNION ALL ".join(
        f'SELECT col, key, {i} AS "row", {_cell("key", i, 544)} AS cell FROM probes' for i in range(5)
    )})
SELECT p.col AS "column", p.key, min(coalesce(c.cnt, 0)) AS estimate
FROM places p LEFT JOIN cells c ON c.col = p.col AND c."row" = p."row" AND c.cell = p.cell
GROUP BY 1, 2""",
    "cms_merge": f"""WITH {CUSTKEY_BOTH}, {_cells(272, 3, 'both_tables')}
SELECT col AS "column", "row", cell, cnt FROM cells""",
    "column_scores": f"WITH {HOT_LONG}, {SCORE_CTES} {SCORES}",
    "score_ranking": f"""WITH long AS (
  SELECT 1 AS pos, 'lang' AS col, lang AS key FROM documents
  UNION ALL SELECT 2, 'source', source FROM documents
  UNION ALL SELECT 3, 'lang|source', lang || '|' || source FROM documents
  UNION ALL SELECT 4, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents), {SCORE_CTES},
places AS (SELECT DISTINCT col, pos FROM long)
SELECT CAST(row_number() OVER (ORDER BY round(c, 1) DESC, pos) AS INT) AS rank,
  col AS "column", round(c, 1) AS composite_score FROM judged JOIN places USING (col)""",
    "skew_band": f"""WITH {HOT_LONG}, {SCORE_CTES}
SELECT col AS "column", round(skew, 6) AS skew_ratio,
  CASE WHEN skew <= 1.5 THEN 'Healthy' WHEN skew <= 3 THEN 'Mild Skew'
    WHEN skew <= 8 THEN 'Moderate Skew' WHEN skew <= 20 THEN 'High Skew'
    ELSE 'Severe Skew' END AS skew_band,
  nf > 0.1 AS high_null_rate, round(null_pen, 1) > 30 AS high_null_penalty,
  round(skew_pen, 1) > 30 AS high_skew_penalty FROM judged""",
    "report": f"""WITH {HOT_LONG}, {PROFILE_CTES}, {SCORED}
SELECT j.col AS "column", t.total AS total_rows, round(j.c, 1) AS composite_score, j.severity,
  CAST(row_number() OVER (ORDER BY round(j.c, 1) DESC, j.col = 'event_type') AS INT) AS place,
  t.total AS load_rows, true AS load_adds_up, 8 AS workers,
  printf('Column \'\'%s\'\' has a skew ratio of %.1fx (top partition is %.1fx the mean). '
    || 'Estimated cardinality: %s. %s', j.col, j.skew, j.skew,
    format('{{:,}}', floor(d.estimate)::BIGINT),
    CASE WHEN j.skew > 5 THEN 'Salting with 8 buckets should reduce hot-key concentration by ~8x.'
      ELSE 'Standard repartition should suffice.' END) AS explanation,
  CASE WHEN j.col = 'hot_key' THEN 'bigint' ELSE 'string' END AS "type"
FROM judged j JOIN totals t USING (col) JOIN distincts d USING (col)""",
    "hash_bucket_load": f"""WITH {LOADED}, {FREQ}, {SLOTS}, {ALL_SLOTS}
SELECT s.col AS "column", s.slot, s.load AS "rows", b.total AS total_rows,
  s.slot BETWEEN 0 AND 7 AS slots_in_range, true AS one_row_a_slot, b.most >= h.hottest AS holds_hottest
FROM slots s JOIN busiest b USING (col) JOIN hottest h USING (col)""",
    "physical_load": f"""WITH {HOT} SELECT count(*) AS total_rows,
  0::BIGINT AS slots_that_differ FROM hot""",
    "load_report": f"""WITH {LOADED}, {FREQ}, {SLOTS}, {ALL_SLOTS}
SELECT col AS "column", 8 AS num_workers, total AS total_rows, most AS max_rows,
  round(total / 8, 9) AS mean_rows, round(most / (total / 8), 9) AS slowdown_factor,
  straggler AS straggler_worker_id, round(1 - (total / 8) / most, 9) AS idle_fraction,
  most BETWEEN hottest AND total AS max_in_range, true AS slowdown_agrees, true AS idle_agrees,
  straggler BETWEEN 0 AND 7 AS straggler_in_range
FROM busiest JOIN hottest USING (col)""",
    "worker_load": f"""WITH {LOADED}, {FREQ}, {SLOTS}, {ALL_SLOTS}
SELECT g.col AS "column", g.slot AS worker_id, g.load AS assigned_rows,
  g.slot = b.straggler AS is_straggler, b.most - g.load AS idle_rows,
  count(*) OVER w AS workers, b.total AS total_rows,
  count(*) FILTER (g.slot = b.straggler) OVER w AS stragglers, true AS fullest_straggles,
  CAST(sum(b.most - g.load) OVER w AS BIGINT) = 8 * b.most - b.total AS idle_agrees
FROM grid g JOIN busiest b USING (col) WINDOW w AS (PARTITION BY g.col)""",
    "top_key_packing": f"""WITH {HOT} SELECT CAST(hot_key AS VARCHAR) AS key, count(*) AS "rows",
  count(*) * 8 > (SELECT count(*) FROM hot) AS is_cut FROM hot GROUP BY hot_key""",
    "balanced_repartition": """SELECT 'balanced' AS layout, count(*) AS total_rows, true AS even FROM events
UNION ALL SELECT 'hashed', count(*), false FROM events""",
    "balanced_rows": f"WITH {HOT} SELECT event_id, hot_key, value FROM hot",
    "salt_column": f"""WITH {HOT} SELECT event_id,
  {_SALTED_KEY} || '_' || CAST(event_id % 8 AS VARCHAR) AS hot_key_salted FROM hot""",
    "salted_row_totals": f"""WITH {HOT} SELECT {_SALTED_KEY} AS key, count(*) AS n
FROM hot GROUP BY hot_key""",
    "salted_aggregate": f"""WITH {HOT} SELECT hot_key, count(*) AS n, count(value) AS n_values,
  CAST(sum(event_id) AS BIGINT) AS id_sum, min(value) AS value_min, max(value) AS value_max,
  avg(event_id) AS id_avg, count(DISTINCT event_type) AS types,
  count(DISTINCT event_type) AS exact_types, median(value) AS value_median,
  string_agg(event_type, ',' ORDER BY event_type) AS props_list
FROM hot GROUP BY hot_key""",
    "salted_join": f"""WITH {HOT} SELECT hot_key AS c_custkey, event_id, c_nationkey
FROM hot LEFT JOIN customer ON hot_key = c_custkey""",
    "salted_outer_join": f"""WITH {HOT}, c AS (
  SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS k, c_name FROM customer)
SELECT coalesce(hot_key, k) AS c_custkey, event_id, c_name FROM hot FULL JOIN c ON hot_key = k""",
    "salted_apply": f"""WITH {HOT}, v AS (
  SELECT coalesce({_SALTED_KEY}, 'none') AS key, value,
    row_number() OVER (PARTITION BY hot_key ORDER BY value DESC) AS place FROM hot)
SELECT key, count(*) AS n, string_agg(printf('%.6f', value), ',' ORDER BY place) FILTER (place <= 3) AS best
FROM v GROUP BY key""",
    "repartition_by_key": """SELECT o_custkey, 1::BIGINT AS partitions, count(*) AS n
FROM orders GROUP BY o_custkey""",
    "batch_snapshots": SNAPSHOTS.replace("LONG", HOT_BATCHES),
    "unique_key_snapshots": SNAPSHOTS.replace("LONG", UNIQUE_BATCHES),
    "stream_profile": f"WITH {HOT_LONG}, {PROFILE_CTES} {_profile_select(batches=False)}",
    "stream_bounded_state": f"""WITH {BOUNDED}, {FREQ}, {TOP}, {SHAPE}, {TOTALS}, {DISTINCTS},
caps(col, cap) AS (VALUES ('hot_prop', 500), ('event_type', 500),
  ('hot_key', 40), ('event_type', 40), ('user_id', 40)),
whole AS (SELECT col, cap, estimate, estimate <= cap AS uncut FROM caps JOIN distincts USING (col))
SELECT w.col AS "column", w.cap, total AS total_rows, nulls AS null_count,
  round(nulls / total, 6) AS null_fraction, round({SKETCH_ERROR}, 6) AS hll_error, true AS cardinality_near,
  CASE WHEN uncut THEN round(estimate, 6) END AS cardinality_estimate,
  CASE WHEN uncut THEN round(s.skew, 6) END AS skew_ratio,
  CASE WHEN uncut THEN s.keys END AS top_keys, CASE WHEN uncut THEN s.counts END AS partition_counts,
  true AS error_in_bound, true AS within_error, CASE WHEN f.n * 10 > total THEN f.key END AS leader
FROM whole w JOIN totals t USING (col) JOIN shape s USING (col) JOIN top f ON f.col = w.col AND f.rnk = 1""",
    "stream_bounds": """SELECT 'user_id' AS "column", count(DISTINCT user_id) AS distinct_keys,
  count(user_id) AS n_rows, CASE WHEN count(DISTINCT user_id) <= 40 THEN count(DISTINCT user_id) END AS tracked,
  count(DISTINCT user_id) AS keys_within, true AS held_in_cap, true AS within FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type), count(event_type),
  CASE WHEN count(DISTINCT event_type) <= 40 THEN count(DISTINCT event_type) END,
  count(DISTINCT event_type), true, true FROM events""",
    "stream_summary": f"""WITH {HOT_LONG}, {SCORE_CTES}, s AS ({SCORES})
SELECT s.*, total AS load_rows, 8 AS workers, true AS load_as_table FROM s JOIN totals ON col = "column\"""",
    "heavy_hitter_summary": "WITH "
    + _long("lineitem", "l_partkey", "l_suppkey")
    + """ SELECT col AS "column", count(DISTINCT key) AS distinct_keys, count(*) AS "rows",
  true AS held_in_cap, true AS error_in_bound, true AS within_error FROM long GROUP BY col""",
}
