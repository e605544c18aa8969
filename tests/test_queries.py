"""Every registered query against its SQL counterpart on the driver's tables."""

import pytest

import __spark_entry__ as entry_point
import compare

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


def test_entry_and_registry(spark):
    assert entry_point.entry(spark).count() == 3
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    assert columns and rows
    if name in ORACLES:
        con = compare.connect(sf_dir)
        assert (columns, rows) == compare.duck_rows(con, ORACLES[name])


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """A folder with ``events`` alone: null, negative and large keys, texts of all lengths."""
    types = ["e", "a", "ab", "abc", "click", "héé", "漢字-漢", None, "a longer type"]
    rows = [
        (i, (None, -1, -(2**40) - i, 7, i % 60, 2**62 + i)[i % 6], types[i % 9], f"p{i % 30}") for i in range(900)
    ]
    path = tmp_path_factory.mktemp("odd")
    schema = "event_id bigint, user_id bigint, event_type string, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def by_value(spark, folder, name):
    """(columns, rows) of a query, equal to those of its SQL over the folder's events."""
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    columns, rows = compare.spark_rows(QUERIES[name](spark, folder))
    assert (columns, rows) == compare.duck_rows(con, ORACLES[name])
    return columns, [dict(zip(columns, r)) for r in rows]


def test_hash_bucket_load_has_every_slot(spark, odd_events):
    _, rows = by_value(spark, odd_events, "hash_bucket_load")
    places = [(r["column"], r["slot"]) for r in rows]
    assert len(places) == len(set(places)) > 3
    for c in ("hot_key", "event_type", "user_id"):
        assert sum(r["rows"] for r in rows if r["column"] == c) == 900


def test_load_report_has_every_figure(spark, odd_events):
    columns, rows = by_value(spark, odd_events, "load_report")
    assert {"max_rows", "slowdown_factor", "straggler_worker_id", "idle_fraction"} <= set(columns)
    assert all(abs(r["slowdown_factor"] - r["max_rows"] / 112.5) < 1e-6 for r in rows) and len(rows) == 3


def test_worker_load_has_every_worker(spark, odd_events):
    _, rows = by_value(spark, odd_events, "worker_load")
    assert len(rows) == 3 * 8 and sum(r["is_straggler"] for r in rows) == 3
    assert sum(r["assigned_rows"] for r in rows) == 3 * 900


def test_stream_bounded_state_has_the_profile_of_columns_that_fit(spark, odd_events):
    _, rows = by_value(spark, odd_events, "stream_bounded_state")
    of = {(r["column"], r["cap"]): r for r in rows}
    assert len(rows) == len(of) == 5
    fits = of["hot_prop", 500]
    assert fits["cardinality_estimate"] == 19 and fits["top_keys"].startswith("none,")
    assert of["event_type", 40]["partition_counts"] == of["event_type", 500]["partition_counts"] != None  # noqa: E711
    assert of["user_id", 40]["top_keys"] is None and of["user_id", 40]["within_error"]


def test_stream_bounds_counts_tracked_keys(spark, odd_events):
    _, rows = by_value(spark, odd_events, "stream_bounds")
    of = {r["column"]: r for r in rows}
    assert of["event_type"]["tracked"] == 8 and of["user_id"]["tracked"] is None
    assert of["user_id"]["keys_within"] == of["user_id"]["distinct_keys"] > 40
