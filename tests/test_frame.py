from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.errors import PathDoesNotExist, SchemaError
from millrace.operators import frame
from millrace.plans.runner import modify
from millrace.sources import parquet


@pytest.fixture
def numbers(spark, tmp_path):
    def make(rows: int, files: int) -> str:
        path = f"{tmp_path}/numbers-{rows}-{files}"
        parquet.write(spark.range(rows).withColumn("foo", F.lit("bar")).repartition(files), path)
        return path

    return make


def test_keep_in_listed_order(spark):
    df = spark.range(3).withColumn("foo", F.lit(1)).withColumn("baz", F.lit(2))
    assert frame.keep("baz", "id")(df).columns == ["baz", "id"]


@pytest.mark.parametrize("operation", [frame.keep("no"), frame.drop("no"), frame.rename({"no": "x"}), frame.hash_column("no", "h"), frame.deduplicate("no")])
def test_missing_column(spark, operation):
    with pytest.raises(SchemaError):
        operation(spark.range(3))


def test_rename_is_simultaneous(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert frame.rename({"a": "b", "b": "a"})(df).first().asDict() == {"b": 1, "a": 2}


def test_hash_of_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xde\xad\xbe\xef"))], "id int, data binary")
    assert frame.hash_column("data", "hash")(df).first().hash == "5f78c33274e43fa9de5659265c1d917e25c03722dcb0b8d27db8d5feaa813953"


def test_deduplicate_keeps_first_and_equal_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 4 else k % 5, {"a": k}) for k in range(18)], "id int, v int, m map<string,int>")
    got = frame.deduplicate("v", order="id")(df)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    plain = frame.deduplicate("v", order="id")(df.drop("m"))
    assert sorted(r.id for r in plain.collect()) == [0, 1, 2, 3, 4]
    assert frame.deduplicate("v")(df).count() == 5
    assert frame.deduplicate("v", order="id")(df.limit(0)).count() == 0


def test_repartition_arguments():
    with pytest.raises(ValueError):
        frame.repartition()
    with pytest.raises(ValueError):
        frame.repartition(chunks=1, size=1)


@pytest.mark.parametrize(("rows", "before", "after"), [(100, 1, 20), (100, 20, 1), (100, 20, 25), (20, 1, 25)])
def test_exact_number_of_files(spark, tmp_path, numbers, rows, before, after):
    out = modify(spark, numbers(rows, before), f"{tmp_path}/out", [], chunks=after)
    assert len(out) == after
    assert spark.read.parquet(*out).count() == rows


def test_repartition_by_size(spark):
    df = frame.repartition(size=64)(spark.range(100))
    assert df.rdd.getNumPartitions() == 26


def test_modify_runs_once_and_reads_lists(spark, tmp_path, numbers):
    paths = [numbers(10, 1), numbers(20, 2)]
    out = modify(spark, paths, f"{tmp_path}/out", [frame.drop("foo")])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
    assert modify(spark, paths[0], f"{tmp_path}/out", []) == out
    with pytest.raises(PathDoesNotExist):
        modify(spark, f"{tmp_path}/none", f"{tmp_path}/out2", [])


def test_compression(spark, tmp_path):
    import pyarrow.parquet as pq

    plain = parquet.write(spark.range(5), f"{tmp_path}/a")[0]
    snappy = parquet.write(spark.range(5), f"{tmp_path}/b", compression="snappy")[0]
    codec = lambda p: pq.ParquetFile(p.removeprefix("file:")).metadata.row_group(0).column(0).compression
    assert (codec(plain), codec(snappy)) == ("UNCOMPRESSED", "SNAPPY")


def test_get_or_create(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert parquet.get_or_create(make, f"{tmp_path}/x", spark).count() == 3
    assert made == [1]


def test_schemas_are_open(spark):
    df = spark.createDataFrame([("a", "int x;", 1)], "id string, source string, foo int")
    assert schema.validate(df, schema.SourceDataset) is df
    with pytest.raises(SchemaError):
        schema.validate(df, schema.BinaryDataset)
    with pytest.raises(SchemaError):
        schema.validate(df.withColumn("source", F.lit(1)), schema.SourceDataset)
    with pytest.raises(SchemaError):
        schema.validate(df.select("source"), schema.SourceDataset)


def test_null_check_raises_when_computed(spark):
    df = spark.createDataFrame([("a", None)], "id string, source string")
    with pytest.raises(Exception, match="allows no null"):
        schema.validate(df, schema.SourceDataset, nulls=True).collect()


def test_token_arrays_fit(spark):
    df = spark.createDataFrame([("a", [1], [1], 0)], "id string, tokens array<int>, mask array<bigint>, label int")
    schema.validate(df, schema.TokenizedClassificationDataset)
    with pytest.raises(SchemaError):
        schema.validate(df.withColumn("tokens", F.array(F.lit("x"))), schema.TokenizedDataset)


def test_number(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("id", "cast(id % 10 as string) as s")
    got = frame.number(df, "at", F.col("s").desc(), "id").collect()
    want = sorted(((f"{k % 10}", k) for k in range(1000)), key=lambda x: (-int(x[0]), x[1]))
    assert [(r.s, r.id) for r in sorted(got, key=lambda r: r.at)] == want
    assert frame.number(df.limit(0), "at", "id").count() == 0


def test_repartition_by_size_runs_what_leads_to_it_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    frame.repartition(size="1KB")(spark.range(500).select(counted("id").alias("x"))).count()
    assert seen.value == 500
