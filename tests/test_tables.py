"""The service's tables: over JDBC, and bucketed in the catalog with their commands."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.errors import PathDoesNotExist, PathExists, SchemaError, UnknownUser
from millrace.operators import service
from millrace.sources import jdbc
from millrace.sources.tables import Tables


@pytest.fixture
def url(spark):
    return jdbc.database(spark, f"t_{uuid.uuid4().hex}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- JDBC


def test_a_table_comes_back_in_ranges(spark, url):
    df = spark.range(1000).select("id", F.concat(F.lit("ü "), "id").alias("name"), (F.col("id") % 3).cast("int").alias("state"), F.when(F.col("id") % 7 > 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("at"))
    jdbc.write_table(df, url, "things", 3, batch=100)
    for key in ("id", None):
        back = jdbc.read_table(spark, url, "things", key, 4)
        assert back.rdd.getNumPartitions() == (4 if key else 1)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sizes = [len(p) for p in jdbc.read_table(spark, url, "things", "id", 4).rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 252


def test_filters_and_columns_go_to_the_database(spark, url):
    jdbc.write_table(spark.range(50).select("id", F.col("id").cast("string").alias("name"), F.lit(1).alias("other")), url, "things")
    found = jdbc.read_table(spark, url, "things", "id", 2).filter("id >= 45 and name <> '47'").select("id")
    assert "PushedFilters: [*IsNotNull(id), *IsNotNull(name), *GreaterThanOrEqual(id,45), *Not(EqualTo(name,47))]" in plan(found) and "other" not in plan(found)
    assert sorted(r.id for r in found.collect()) == [45, 46, 48, 49]


def test_null_keys_and_empty_tables(spark, url):
    jdbc.write_table(spark.createDataFrame([(None, "a"), (5, "b"), (9, "c"), (None, "d")], "k long, v string"), url, "pairs")
    assert sorted(r.v for r in jdbc.read_table(spark, url, "pairs", "k", 3).collect()) == list("abcd")
    jdbc.write_table(spark.createDataFrame([], "k long, v string"), url, "nothing")
    assert jdbc.read_table(spark, url, "nothing", "k", 3).count() == 0
    jdbc.write_table(spark.createDataFrame([(7, "e")], "k long, v string"), url, "pairs", mode="append")
    assert jdbc.read_table(spark, url, "pairs", "k").count() == 5


def test_names_are_names(spark, url):
    for bad in ("a; drop table b", 'x"y', ""):
        with pytest.raises(ValueError):
            jdbc.read_table(spark, url, bad)
        with pytest.raises(ValueError):
            jdbc.read_table(spark, url, "things", bad or "?")


def test_a_cluster_without_a_database(spark, sf, monkeypatch):
    """The query needs no database where none is named; the operator says what is missing."""
    from millrace.plans import queries_service

    from .oracle import spark_rows, sql_rows

    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    monkeypatch.setattr(jdbc, "write_table", None)
    with pytest.raises(ValueError):
        jdbc.database(spark, "none")
    run, sql = queries_service.QUERIES["service_tables"]
    assert spark_rows(run(spark, sf)) == sql_rows(sql, sf)


# --- bucketed tables


@pytest.fixture
def tables(spark, tmp_path):
    made = Tables(spark, f"file://{tmp_path}/service")
    made.initialize(buckets=3)
    users = spark.createDataFrame([(k, f"user{k}", k == 1) for k in range(1, 9)], "id long, username string, admin boolean")
    rows = spark.range(60).select(
        "id", (F.col("id") % 7 + 1).alias("user_id"), F.lit(0).alias("type"), F.concat(F.lit("In "), "id").alias("input"), F.lit(None).cast("string").alias("output"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id))").alias("timestamp"), (F.col("id") % 3).cast("int").alias("state"),
        F.when(F.col("id") % 5 == 0, 3).alias("rating"), F.lit(None).cast("string").alias("comments"),
    )
    made.replace("user", users)
    made.replace("completion", rows)
    yield made
    spark.sql(f"DROP DATABASE IF EXISTS {made.database} CASCADE")


def test_tables_join_without_a_shuffle(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users, rows = tables.table("user"), tables.table("completion")
        joined, report = service.with_users(rows, users), service.user_report(users, rows)
        for df in (joined, report):
            df.collect()
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        assert joined.count() == 60 and report.count() == 8
        # the same without buckets, where a user's rows may be split
        spark.conf.set("spark.sql.sources.bucketing.enabled", "false")
        plain = service.user_report(tables.table("user"), tables.table("completion"))
        assert "Exchange" in plan(plain) and sorted(map(tuple, plain.collect())) == sorted(map(tuple, report.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.enabled")


def test_versions(spark, tables, tmp_path):
    old = tables.table("completion")
    tables.replace("completion", service.purge(old))
    assert old.filter("state = 1").count() == 20 and tables.table("completion").filter("state = 1").count() == 0
    assert [v for v, _ in tables._versions("completion")] == [1, 2]  # the one before stays for its readers
    with pytest.raises(PathExists):
        tables._write("completion", old, 2, 3)
    with pytest.raises(SchemaError):
        tables.replace("user", old)
    again = Tables(spark.newSession(), f"file://{tmp_path}/service")  # another session declares what lies there
    assert again.table("completion").count() == 60
    # a version that was never finished is not seen
    (tmp_path / "service" / "completion" / "v9-b3").mkdir()
    assert again.table("completion").filter("state = 0").count() == 40


def test_create_and_drop(spark, tables, tmp_path):
    with pytest.raises(PathExists):
        tables.initialize()
    tables.destroy()
    assert not (tmp_path / "service").exists()
    for act in (tables.destroy, lambda: tables.table("user"), lambda: tables.replace("user", spark.range(1))):
        with pytest.raises(PathDoesNotExist):
            act()
    tables.initialize(2)
    assert tables.table("completion").count() == 0 and tables.table("user").columns == ["id", "username", "admin"]


def test_commands(spark, tables, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "cluster", lambda *a, **k: spark)
    monkeypatch.setattr(cli, "flush", lambda spark: None)
    at = ["--tables", f"file://{tmp_path}/service"]

    def told(*args):
        assert cli.main(["service", args[0], *at, *args[1:]]) == 0
        return capsys.readouterr().out.splitlines()

    assert told("users")[:2] == ["user1\tadmin\t9\t2", "user2\t-\t9\t2"] and told("users", "-s")[-1].startswith("user8\t-\t0")
    assert [x.split("\t")[1] for x in told("completions", "-l", "2", "-u", "user3", "-i", "in 1", "-d", "2024-01-01")] == ["16"]
    assert told("admin", "user5", "--promote") == ["user5 promoted"] and tables.table("user").filter("admin").count() == 2
    with pytest.raises(UnknownUser):
        told("admin", "nobody", "--demote")
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert told("purge") == [] and tables.table("completion").filter("state = 1").count() == 20
    assert told("purge", "--confirm") == ["20 running completion(s) queued again"] and told("purge", "--confirm") == ["0 running completion(s) queued again"]
    told("export", f"{tmp_path}/out", "-d", "2024-01-02")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 36
    told("destroy", "--confirm")
    told("initialize", "--buckets", "2")
    assert tables.table("completion").count() == 0


def test_repartition_by_size_is_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "cluster", lambda *a, **k: spark)
    monkeypatch.setattr(cli, "flush", lambda spark: None)
    spark.range(30_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).write.parquet(f"{tmp_path}/in")
    assert cli.main(["repartition", f"{tmp_path}/in", f"{tmp_path}/out", "--size", "200KB"]) == 0
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 200_000 and spark.read.parquet(f"{tmp_path}/out").count() == 30_000
