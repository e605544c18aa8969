import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from keybalance import workdir
from keybalance.operators import profile as P
from keybalance.operators.frequency import key_frequency, top_keys
from keybalance.sources import arrow_ipc, sinks, staging, tables, zipf


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_csv_with_inferred_types_and_separator(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;name;x\n1;a;0.5\n2;;1.5\n")
    df = tables.load_table(spark, str(tmp_path / "t.csv"), sep=";")
    assert tables.schema_info(df) == {"id": "int", "name": "string", "x": "double"}
    assert df.where("name IS NULL").count() == 1


def test_reader_by_suffix(spark, events, tmp_path):
    events.limit(50).write.parquet(str(tmp_path / "a.PARQUET"))
    events.limit(50).write.parquet(str(tmp_path / "plain"))
    for name in ("a.PARQUET", "plain"):
        assert tables.load_table(spark, str(tmp_path / name)).count() == 50
    (tmp_path / "text").write_text("k\n1\n2\n")
    assert tables.load_table(spark, str(tmp_path / "text")).count() == 2
    with pytest.raises(ValueError, match="could not read"):
        tables.load_table(spark, str(tmp_path / "missing"))


def test_arrow_formats_in_one_folder(spark, tmp_path):
    table = pa.table({"k": ["a", None, "b"], "n": pa.array([1, 2, 3], pa.int64())})
    for name, opener in (("f.arrow", ipc.new_file), ("s.arrow", ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as sink, opener(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=2)
    inferred = arrow_ipc.read_arrow_ipc(spark, str(tmp_path))
    assert tables.schema_info(inferred) == {"k": "string", "n": "bigint"}
    declared = arrow_ipc.read_arrow_ipc(spark, str(tmp_path), "n int, k string")
    assert declared.columns == ["n", "k"]
    for df in (inferred, declared):
        assert df.count() == 6 and df.agg(F.sum("n")).first()[0] == 12
    assert P.profile(inferred, "k").first().null_count == 2


def test_arrow_files_with_different_columns(spark, tmp_path):
    for name, table in (("a", {"k": ["x"], "n": [1]}), ("b", {"n": [2], "z": [True]})):
        table = pa.table(table)
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as sink, ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
    df = arrow_ipc.read_arrow_ipc(spark, str(tmp_path))
    assert df.columns == ["k", "n", "z"]
    assert sorted(map(tuple, df.collect()), key=str) == [("x", 1, None), (None, 2, True)]
    odd = pa.table({"n": ["text"]})
    with pa.OSFile(str(tmp_path / "c.arrow"), "wb") as sink, ipc.new_stream(sink, odd.schema) as w:
        w.write_table(odd)
    with pytest.raises(ValueError, match="'n'"):
        arrow_ipc.read_arrow_ipc(spark, str(tmp_path))


def test_damaged_arrow_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.arrow").write_bytes(b"ARROW1\0\0 broken")
    with pytest.raises(Exception):
        arrow_ipc.read_arrow_ipc(spark, str(tmp_path), "k int").collect()


def arrow_file(path, rows, size, opener=ipc.new_file, **options):
    table = pa.table({"n": pa.array(range(rows), pa.int64()), "k": pa.array([f"k{i % 7}" for i in range(rows)]).dictionary_encode()})
    with pa.OSFile(str(path), "wb") as sink, opener(sink, table.schema, options=ipc.IpcWriteOptions(**options)) as writer:
        writer.write_table(table, max_chunksize=size)


@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}])
def test_one_arrow_file_is_read_by_many_tasks(spark, tmp_path, options):
    arrow_file(tmp_path / "big.arrow", 10_000, 100, **options)
    df = arrow_ipc.read_arrow_ipc(spark, str(tmp_path / "big.arrow"), "n bigint, k string")
    tasks = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) <= 3000
    assert sorted(map(tuple, df.collect())) == [(i, f"k{i % 7}") for i in range(10_000)]
    one_batch = arrow_ipc.read_arrow_ipc(spark, str(tmp_path), "n bigint", split_bytes=1)
    assert 8 < one_batch.rdd.getNumPartitions() < 100 and one_batch.count() == 10_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_arrow_streams_are_read_in_order_by_one_task(spark, tmp_path):
    arrow_file(tmp_path / "s.arrows", 5000, 64, ipc.new_stream)
    df = arrow_ipc.read_arrow_ipc(spark, str(tmp_path), split_bytes=1000)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 1
    assert [r.n for r in df.collect()] == list(range(5000))


def test_arrow_files_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    arrow_file(tmp_path / "f.arrow", 500, 10)
    arrow_file(tmp_path / "s.arrow", 300, 10, ipc.new_stream)
    monkeypatch.setattr(arrow_ipc, "_reachable", lambda path: False)
    df = arrow_ipc.read_arrow_ipc(spark, str(tmp_path))
    assert df.columns == ["n", "k"] and df.count() == 800
    assert "content" in df._jdf.queryExecution().executedPlan().toString()


def test_arrow_addresses(tmp_path):
    assert arrow_ipc.located("file:/a b%20/c")[1] == "/a b%20/c"
    assert arrow_ipc.located("file:///x")[1] == "/x"
    assert not arrow_ipc._reachable("viewfs://store/in/x.arrow")
    assert not arrow_ipc._reachable(f"file:{tmp_path}/absent.arrow")


def test_empty_arrow_files(spark, tmp_path):
    arrow_file(tmp_path / "none.arrow", 0, 10)
    df = arrow_ipc.read_arrow_ipc(spark, str(tmp_path))
    assert df.columns == ["n", "k"] and df.count() == 0


def test_staged_arrow(spark, events):
    same(arrow_ipc.read_arrow_ipc(spark, staging.stage_arrow_ipc(events.repartition(3)), events.schema), events)


def test_partitioned_write(spark, events, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_partitioned(events, ["event_type"], out, n=4, records_per_file=500)
    back = spark.read.parquet(out).select(*events.columns)
    same(back, events)
    files = back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert files <= 500
    with pytest.raises(ValueError, match="distinct keys"):
        sinks.write_partitioned(events, ["user_id"], out, max_directories=100)
    many = events.select("user_id").distinct().count()
    sinks.write_partitioned(events, ["user_id"], str(tmp_path / "exact"), max_directories=many)


def test_partition_keys_keep_type_and_value(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), (None, 2), ("a b/=", 3)], "k string, n int")
    sinks.write_partitioned(df, ["k"], str(tmp_path / "t"))
    same(sinks.read_partitioned(spark, str(tmp_path / "t"), df.schema), df)
    with pytest.raises(ValueError, match="empty strings"):
        sinks.write_partitioned(df.unionByName(spark.createDataFrame([("", 4)], df.schema)), ["k"], str(tmp_path / "u"))


@pytest.mark.parametrize("exponent", [0.7, 1.0, 1.5, 3.0])
def test_zipf_shares(spark, exponent):
    rows = spark.range(200_000)
    drawn = zipf.zipf_keys(rows, ["id"], 1000, exponent)
    counts = {r["rank"]: r["count"] for r in drawn.groupBy("rank").count().collect()}
    assert sum(counts.values()) == 200_000 and min(counts) >= 1 and max(counts) <= 1000
    weights = [r**-exponent for r in range(1, 1001)]
    for rank in (1, 2, 3, 10, 100):
        expected = 200_000 * weights[rank - 1] / sum(weights)
        assert abs(counts.get(rank, 0) - expected) < 5 * expected**0.5 + 1
    tail = sum(n for r, n in counts.items() if r > 500)
    expected = 200_000 * sum(weights[500:]) / sum(weights)
    assert abs(tail - expected) < 5 * expected**0.5 + 1


def test_zipf_over_many_keys_needs_no_table(spark):
    n, rows = 10**9, 100_000
    drawn = zipf.zipf_keys(spark.range(rows), ["id"], n, 1.1)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # Euler-Maclaurin: all weights, and those of the ranks beyond a million.
    total = sum(r**-1.1 for r in range(1, 1001)) + sum(
        sign * (x**-0.1 / 0.1 - 0.5 * x**-1.1) for sign, x in ((1, 1000.0), (-1, float(n)))
    )
    row = drawn.agg(
        F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("rank") > 10**6).alias("rare"), F.max("rank").alias("most")
    ).first()
    rare = rows * ((1e6**-0.1 - n**-0.1) / 0.1) / total
    for got, expected in ((row["first"], rows / total), (row["rare"], rare)):
        assert abs(got - expected) < 5 * expected**0.5
    assert 10**8 < row["most"] <= n


def test_zipf_draws_are_repeatable_and_need_sense(spark):
    rows = spark.range(5000)
    same(zipf.zipf_keys(rows, ["id"], 50), zipf.zipf_keys(rows.repartition(7), ["id"], 50))
    assert zipf.zipf_keys(rows, ["id"], 1).agg(F.max("rank")).first()[0] == 1
    for n, exponent in ((0, 1.5), (10, 0.0)):
        with pytest.raises(ValueError):
            zipf.zipf_keys(rows, ["id"], n, exponent)


def test_skewed_table_matches_published_figures(spark):
    df = zipf.skewed_table(spark.range(500_000), ["id"])
    rows = {r["column"]: r for r in P.profile(df, "user_id, region").collect()}
    user, region = rows["user_id"], rows["region"]
    assert user.total_rows == 500_000 and user.top_keys[0].key == "user_0"
    assert abs(user.null_fraction - 0.05) < 0.002
    assert abs(user.skew_ratio - 9.2) < 0.1 and abs(user.cardinality_estimate - 5060) < 300
    assert abs(region.skew_ratio - 2.1) < 0.02
    again = zipf.skewed_table(spark.range(500_000).repartition(3), ["id"])
    same(df.where("id < 2000"), again.where("id < 2000"))


def test_working_folder_needs_a_shared_root(spark, monkeypatch):
    root = workdir.shared_root(spark)
    assert workdir.fresh_dir(spark, "x").startswith(f"{root}/x-")
    assert workdir.fresh_dir(spark, "x") != workdir.fresh_dir(spark, "x")


def test_top_keys_of_a_csv_equal_those_of_its_source(spark, events):
    path = staging.stage_csv(events.select("user_id"))
    back = tables.read_csv(spark, path, schema="user_id bigint")
    same(top_keys(key_frequency(back, "user_id")), top_keys(key_frequency(events, "user_id")))


def test_footer_counts_read_no_column(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("a.b"), F.lit(None).cast("string").alias("none"), F.array("id").alias("list")
    )
    df.repartition(3).write.parquet(path)
    got = [tuple(r) for r in tables.footer_counts(spark, path, ["a.b", "none"]).collect()]
    nulls = len(range(0, 1000, 7))
    assert got == [("a.b", 1000, nulls, nulls / 1000), ("none", 1000, 1000, 1.0)]
    with pytest.raises(ValueError, match="nested"):
        tables.footer_counts(spark, path, ["list"])
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plan = tables._counts(spark.read.parquet(path), ["a.b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "COUNT(*)" in plan.split("PushedAggregation: ")[1]
    assert {name: spark.conf.get(name) for name in settings} == before
    spark.range(0).write.parquet(str(tmp_path / "no-rows"))
    assert tuple(tables.footer_counts(spark, str(tmp_path / "no-rows"), ["id"]).first()) == ("id", 0, 0, 0.0)
