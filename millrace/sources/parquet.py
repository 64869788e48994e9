"""Parquet datasets: directories of files, read and written through one place."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PathDoesNotExist
from ..functions.text import parse_size
from ..schema import Schema, validate
from .shared import own_session, settings


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a dataset was written to its end; a failed or running write does not count."""
    return exists(spark, f"{path}/_SUCCESS")


def files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a dataset by name."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))


def read(spark: SparkSession, paths: str | list[str], schema: Schema | None = None) -> DataFrame:
    """One or several datasets or files as one DataFrame, checked against ``schema``."""
    some = [paths] if isinstance(paths, str) else list(paths)
    for p in some:
        if not exists(spark, p):
            raise PathDoesNotExist(p)
    df = spark.read.parquet(*some)
    return df if schema is None else validate(df, schema)


def write(df: DataFrame, path: str, compression: str = "uncompressed", mode: str = "overwrite", files_exactly: int | None = None, partition_by: tuple[str, ...] = (), size: int | str | None = None) -> list[str]:
    """Write a dataset and return its files. With ``files_exactly``, empty files make up for empty partitions, which Spark leaves out.

    With ``size``, no file is larger than so many bytes, but for one that holds a single larger row: see :func:`write_sized`.
    """
    spark = df.sparkSession
    if size is not None:
        if files_exactly is not None or partition_by:
            raise ValueError("size goes with neither files_exactly nor partition_by")
        return write_sized(df, path, size, compression, mode)
    out = df.write.option("compression", compression).mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    if files_exactly is not None:
        _pad(df, path, files_exactly - len(files(spark, path)), compression)
    return files(spark, path)


#: A write that is not finished by Spark's own commit: the mark is set by :func:`_finished`.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def _finished(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, f"{path}/_SUCCESS")
    fs.create(p).close()


def _lengths(spark: SparkSession, path: str) -> dict[str, int]:
    fs, p = _path(spark, path)
    return {s.getPath().toString(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")}


#: Partitions that a sized write deals rows to at first, unless there are more shuffle partitions anyway.
MOST_DEALT = 20_000


def write_sized(df: DataFrame, path: str, size: int | str, compression: str = "uncompressed", mode: str = "overwrite", fill: float = 0.5) -> list[str]:
    """Write a dataset in files of at most ``size`` bytes, in one pass over ``df``.

    Rows are dealt evenly and shuffled once; while the query runs, adaptive execution merges small partitions and splits large ones
    towards ``fill`` times the size. Only then is it known how long the files are, which depends on their encoding: those beyond the size, if any, are
    read again and dealt to more files. A file of one row may be larger. The dataset counts as complete when all of that is done.
    """
    spark, limit = df.sparkSession, parse_size(size)
    target = str(max(1, int(limit * fill)))
    run_time = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": target,
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": target,
    }
    # what a task sends to a partition is not split, so that there are as many partitions as the plan's estimate has files
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_time["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(max(usual, min(estimate // int(target), MOST_DEALT)))

    def save(rows: DataFrame, how: str) -> None:
        rows.write.options(**UNMARKED).option("compression", compression).mode(how).parquet(path)

    before = set(_lengths(spark, path)) if mode == "append" and exists(spark, path) else set()
    with settings(spark, run_time):
        save(df.hint("rebalance"), mode)
    parts = 1
    while True:
        large = {p: n for p, n in _lengths(spark, path).items() if n > limit and p not in before}
        several = spark.read.schema(df.schema).parquet(*large).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).filter("n > 1") if large else None
        again = {r["file"].rpartition("/")[2] for r in several.collect()} if large else set()  # a row for each large file
        large = {p: n for p, n in large.items() if p.rpartition("/")[2] in again}
        if not large:
            break
        parts *= 2
        save(spark.read.schema(df.schema).parquet(*large).repartition(parts * -(-sum(large.values()) // limit)), "append")
        fs, _ = _path(spark, path)
        for p in large:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), False)
    _finished(spark, path)
    return files(spark, path)


def _pad(df: DataFrame, path: str, count: int, compression: str) -> None:
    """Add ``count`` files without rows: one is written beside the dataset and copied."""
    if count <= 0:
        return
    spark = df.sparkSession
    beside = f"{path}-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).coalesce(1).write.option("compression", compression).parquet(beside)
    fs, _p = _path(spark, beside)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    empty = files(spark, beside)[0]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(count):
        jvm.FileUtil.copy(fs, jvm.Path(empty), fs, jvm.Path(f"{path}/{empty.rpartition('/')[2].replace('part-', f'part-e{k:05d}-', 1)}"), False, conf)
    fs.delete(jvm.Path(beside), True)


def get_or_create(df_or_make, path: str, spark: SparkSession, **options) -> DataFrame:
    """Read a dataset if it is complete, else compute and write it first."""
    if not complete(spark, path):
        write(df_or_make() if callable(df_or_make) else df_or_make, path, **options)
    return spark.read.parquet(path)


#: Settings under which a scan makes one partition of each file, however small or large.
WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.openCostInBytes": str(1 << 60), "spark.sql.files.minPartitionNum": "1"}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A dataset with one partition for each file, planned in a session of its own: the settings of ``spark`` stay as they are."""
    return own_session(spark, WHOLE_FILES).read.parquet(path)


def map_chunks(spark: SparkSession, source: str, output: str, operations: list[Callable[[DataFrame], DataFrame]], compression: str = "uncompressed") -> list[tuple[str, str]]:
    """Apply ``operations`` file by file: each file that keeps a row becomes one file, in the order of their names. Returns (input, output) names.

    Nothing is shuffled: a task reads a file and writes a file. Operations that need rows of several files together raise. Names follow from the plan, which deals
    the same files to the same tasks in each job on one DataFrame, so that the files can be put in order before the dataset counts as complete.
    """
    base = read_chunks(spark, source)
    out = base
    for operation in operations:
        out = operation(out)
    if "Exchange" in out._jdf.queryExecution().executedPlan().toString():
        raise ValueError("an operation on chunks must not shuffle")
    own = out.sparkSession
    dealt = base.select(F.spark_partition_id().alias("k"), F.col("_metadata.file_name").alias("name")).groupBy("k", "name").agg(F.lit(0)).collect()  # a row for each file
    out.write.options(**UNMARKED).option("compression", compression).mode("overwrite").parquet(output)
    fs, _ = _path(own, output)
    new_path, tag = own.sparkContext._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    written = {int(p.rpartition("/")[2].split("-")[1]): p for p in files(own, output)}
    names = []
    for rank, (name, k) in enumerate(sorted((r["name"], r["k"]) for r in dealt)):
        if k in written:
            names.append((name, f"part-{rank:05d}-{tag}.parquet"))
            fs.rename(new_path(written.pop(k)), new_path(f"{output}/{names[-1][1]}"))
    for p in written.values() if names else []:  # the file that Spark writes for a first task without rows
        fs.delete(new_path(p), False)
    _finished(own, output)
    return names


def number_in_files(spark: SparkSession, path: str, target: str = "row") -> DataFrame:
    """A dataset's rows with ``target``, their number from 0 in the order of files by name and of rows in them.

    No row is moved: a row's place in its file is known to the scan, and what lies before its file is a sum over files, whose
    counts come from a scan that reads no column. The number is the same in every run, however the scan is dealt out.
    """
    df, name = spark.read.parquet(path), F.col("_metadata.file_path")
    counts = df.groupBy(name.alias("_file")).agg((F.max("_metadata.row_index") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_file", before.alias("_before"))  # a row for each file, as the driver's listing has
    rows = df.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(F.broadcast(starts), "_file").withColumn(target, F.col("_before") + F.col("_at")).select(*[c for c in df.columns if c != target], target)


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """``rows`` of a dataset, summed from the files' footers: no column and no page is read."""
    own = own_session(spark, {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"})
    return row_count(own.read.parquet(path))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def with_file(df: DataFrame) -> DataFrame:
    """Add ``file``, the name of the file each row was read from."""
    return df.withColumn("file", F.input_file_name())


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows by name of their file."""
    return with_file(df).orderBy("file")
