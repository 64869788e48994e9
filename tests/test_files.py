"""Readers and sinks that go by files: stripes, chunk-preserving maps, numbers, size-bound output, counts from footers."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.errors import PathDoesNotExist, SchemaError
from millrace.operators import frame
from millrace.schema import BinaryDataset
from millrace.sources import parquet, striped


@pytest.fixture
def folder(tmp_path):
    """Files of 3, 7 and 120 rows, written in another order than that of their names, and what a listing has besides."""
    path = tmp_path / "files"
    path.mkdir()
    at = 0
    for name, n in (("a", 3), ("b", 7), ("c", 120)):
        pq.write_table(pa.table({"id": [f"{name}{k:03d}" for k in range(n)], "n": list(range(at, at + n))}), path / f"{name}.parquet", row_group_size=50)
        at += n
    for name in ("_SUCCESS", ".hidden"):
        (path / name).write_bytes(b"")
    return str(path)


# --- stripes


def test_each_reader_has_its_files_in_order(spark, folder):
    for n in (1, 2, 3, 5):
        rows = striped.read_striped(spark, folder, readers=n, place=True).collect()
        assert len(rows) == 130 and len({r.n for r in rows}) == 130
        for k in range(n):
            own = [r.n for r in rows if r.reader == k]
            assert own == sorted(own) and {r.file[0] for r in rows if r.reader == k} == set("abc"[k::n])
        assert all((r.file[0], r.place) == (r.id[0], int(r.id[1:])) for r in rows)
        parts = striped.read_striped(spark, folder, readers=n).rdd.getNumPartitions()
        assert parts == n  # readers without files have empty partitions


def test_one_reader_alone(spark, folder):
    found = [[r.id[0] for r in striped.read_striped(spark, folder, readers=2, worker=k, batch=7).collect()] for k in range(2)]
    assert Counter(found[0]) == {"a": 3, "c": 120} and Counter(found[1]) == {"b": 7}


def test_one_file_some_columns_and_a_schema(spark, folder):
    rows = striped.read_striped(spark, f"file://{folder}/b.parquet", readers=3, columns=("n",), place=True)
    assert rows.columns == ["n", "reader", "file", "place"] and rows.filter("reader = 0").count() == 7
    with pytest.raises(SchemaError):
        striped.read_striped(spark, folder, schema=BinaryDataset)
    with pytest.raises(PathDoesNotExist):
        striped.read_striped(spark, f"{folder}/none")
    spark.range(2).withColumn("place", F.lit(1)).write.parquet(f"{folder}-place")
    with pytest.raises(ValueError, match="names of places"):
        striped.read_striped(spark, f"{folder}-place", place=True)


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert striped.read_striped(spark, str(tmp_path / "none"), readers=2).count() == 0


def test_types_come_through(spark, tmp_path):
    df = spark.sql("select id, cast(id as string) s, cast(null as int) i, array(id, null) a, timestamp'2024-01-02 03:04:05' t, timestamp_ntz'2024-01-02 03:04:05' tn, date'2024-01-02' d, cast(id as decimal(9,2)) dec, map('k', id) m, named_struct('x', id) st, unhex('ff') b from range(5)")
    df.write.parquet(f"{tmp_path}/t")
    want = sorted(map(str, spark.read.parquet(f"{tmp_path}/t").collect()))
    assert sorted(map(str, striped.read_striped(spark, f"{tmp_path}/t", readers=2).collect())) == want


def test_filters_pass_over_row_groups_and_lose_nothing(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = striped.read_striped(spark, folder, readers=2, place=True)
        every = spark.createDataFrame(rows.collect(), rows.schema)
        for condition in ("n >= 100", "n = 64", "id = 'c054'", "n in (2, 129)", "n < 4 and id > 'a'", "n > 5 and place = 3", "reader = 1"):
            assert rows.filter(condition).orderBy("n").collect() == every.filter(condition).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    groups = pq.ParquetFile(f"{folder}/c.parquet").metadata
    names = {groups.row_group(0).column(k).path_in_schema: k for k in range(2)}
    seen = [striped.can_meet(groups.row_group(g), names, [striped.GreaterThanOrEqual(("n",), 100)]) for g in range(3)]
    assert seen == [False, True, True]
    assert striped.can_meet(groups.row_group(0), names, [striped.EqualTo(("n",), 1.5), striped.EqualTo(("other",), 1), striped.LessThan(("id", "x"), 3)])


# --- chunks and numbers


def test_a_map_keeps_chunks(spark, folder, tmp_path):
    before = {k: spark.conf.get(k, None) for k in parquet.WHOLE_FILES}
    names = parquet.map_chunks(spark, folder, f"{tmp_path}/out", [frame.rename({"n": "number"})])
    assert [a for a, _ in names] == ["a.parquet", "b.parquet", "c.parquet"] and len(parquet.files(spark, f"{tmp_path}/out")) == 3
    assert [pq.ParquetFile(f"{tmp_path}/out/{b}").read().column("number").to_pylist() for _, b in sorted(names, key=lambda x: x[1])] == [list(range(3)), list(range(3, 10)), list(range(10, 130))]
    assert parquet.complete(spark, f"{tmp_path}/out") and {k: spark.conf.get(k, None) for k in parquet.WHOLE_FILES} == before
    # a chunk that keeps no row has no file
    names = parquet.map_chunks(spark, folder, f"{tmp_path}/some", [lambda df: df.filter("n >= 3")])
    assert [a for a, _ in names] == ["b.parquet", "c.parquet"] and spark.read.parquet(f"{tmp_path}/some").count() == 127
    with pytest.raises(ValueError, match="shuffle"):
        parquet.map_chunks(spark, folder, f"{tmp_path}/no", [lambda df: df.distinct()])


def test_many_chunks_keep_their_order(spark, tmp_path):
    spark.range(300).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/in")
    n = len(parquet.files(spark, f"{tmp_path}/in"))
    parquet.map_chunks(spark, f"{tmp_path}/in", f"{tmp_path}/out", [lambda df: df.withColumn("x", F.col("id") * 2)])
    found = [pq.ParquetFile(f.removeprefix("file:")).read().column("id").to_pylist() for f in parquet.files(spark, f"{tmp_path}/out")]
    assert len(found) == n and [x for part in found for x in part] == list(range(300))


def test_numbers_do_not_depend_on_how_files_are_scanned(spark, folder):
    want = [(r.id, r.n) for r in spark.read.parquet(folder).orderBy("n").collect()]
    for least in ("1", "40"):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        try:
            got = parquet.number_in_files(spark, folder)
            assert "Exchange hashpartitioning(id" not in got._jdf.queryExecution().executedPlan().toString()
            assert [(r.id, r.row) for r in got.orderBy("row").collect()] == want
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")


# --- size-bound output


def sizes(path):
    return {p.name: p.stat().st_size for p in Path(path).glob("part-*")}


def test_files_are_within_the_size(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        seen.add(1)
        return "".join(chr(97 + (k * j * j) % 26) for j in range(k % 900))

    df = spark.range(4000).select("id", text("id").alias("text"))
    out = parquet.write(df, f"{tmp_path}/out", size="64KiB")
    found = sizes(f"{tmp_path}/out")
    assert len(out) == len(found) > 20 and max(found.values()) <= 65536 and parquet.complete(spark, f"{tmp_path}/out")
    assert seen.value == 4000  # what leads to the sink ran once
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*"), F.sum("id")).first() == (4000, 4000 * 3999 // 2)


def test_compressible_rows_and_single_large_rows(spark, tmp_path):
    """What the shuffle packs well the files may not: those beyond the size are dealt anew, and a row that is larger stands alone."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 500 == 0, F.repeat(F.sha2(F.col("id").cast("string"), 256), 3000)).otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), 30)).alias("text"))
    parquet.write(df, f"{tmp_path}/out", size="100KB")
    large = [n for n, b in sizes(f"{tmp_path}/out").items() if b > 100_000]
    assert len(large) == 4 and all(pq.ParquetFile(f"{tmp_path}/out/{n}").metadata.num_rows == 1 for n in large)
    assert spark.read.parquet(f"{tmp_path}/out").selectExpr("count(*)", "count(distinct id)").first() == (2000, 2000)
    parquet.write(spark.range(10).selectExpr("id", "cast(id as string) text"), f"{tmp_path}/out", size="100KB", mode="append")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2010 and len([n for n, b in sizes(f"{tmp_path}/out").items() if b > 100_000]) == 4


def test_many_small_partitions_are_merged_at_run_time(spark, tmp_path):
    parquet.write(spark.range(0, 1000, 1, 50), f"{tmp_path}/out", size="1MB")
    assert len(sizes(f"{tmp_path}/out")) == 1
    with parquet.settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        df = spark.range(0, 1000, 1, 50).hint("rebalance")
        df.collect()
        assert "AQEShuffleRead" in df._jdf.queryExecution().executedPlan().toString()
    parquet.write(spark.range(0), f"{tmp_path}/none", size="1MB")
    assert spark.read.schema("id long").parquet(f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        parquet.write(spark.range(1), f"{tmp_path}/x", size=1, files_exactly=2)


# --- counts from footers


def test_count_from_footers(spark, folder):
    found = parquet.footer_count(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first().rows == 130 and "PushedAggregation: [COUNT(*)]" in plan and "ReadSchema: struct<count(*):bigint>" in plan
    assert parquet.row_count(spark.read.parquet(folder)).first().rows == 130
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_sized_files_of_a_table_are_written_once(spark, tmp_path, monkeypatch):
    """Rows are dealt to as many partitions as the table has files: none is too large at first and dealt again."""
    noise = F.concat(*[F.unhex(F.sha2(F.concat("id", F.lit(f"-{k}")), 256)) for k in range(20)])  # as long in a shuffle as in a file
    spark.range(20_000).select("id", noise.alias("text")).repartition(2).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *a, **k: pytest.fail("dealt again"))
    parquet.write(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", size="256KB")
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert max(sizes) <= 256_000 and spark.read.parquet(f"{tmp_path}/out").distinct().count() == 20_000
