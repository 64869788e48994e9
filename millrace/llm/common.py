"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: A word: a run of anything but ASCII white space. Valid in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset directory (any path Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage like a checkpoint does, but as compressed columns: a
    lost executor costs a reread, never a recomputation, and later scans prune.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    for paths in _scratch[-1:]:
        paths.append(path)
    with settings(spark, STAGED):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: While a stage is written: nothing else reads its shuffles, so their files go at its end, and
#: batches for Python are small, so that workers and the buffers that feed them stay so.
STAGED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_scratch: list[list[str]] = []


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(staged: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage` (the object that it returned) that nothing will read again."""
    _delete(staged.sparkSession, staged.staged_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables staged inside are deleted at the end, but for those that are put on the list it gives."""
    kept: list[DataFrame] = []
    _scratch.append([])
    try:
        yield kept
    finally:
        paths, stay = _scratch.pop(), {df.staged_at for df in kept}
        for path in paths:
            if path not in stay:
                _delete(spark, path)
        for outer in _scratch[-1:]:
            outer.extend(stay)


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the ``needed`` ones under names that nothing else has, and what puts the old names back."""
    names = {c: c if c in needed else f"aside_{k}_" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df: df.select(*[F.col(v).alias(c) for c, v in names.items()])


def small(ids: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``ids``, a staged table of a number or two a row, marked for broadcast if its rows are within the bound."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; what fixes held-out folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def binary_search(bounds: Column, key: Column, size: int, strict: bool = False) -> Column:
    """Number of entries of the ascending array ``bounds`` that are <= ``key``, or < ``key`` if ``strict``.

    About log2(size) steps inside one expression, so that ranges can be looked
    up by built-in functions whatever their number.
    """
    steps, s = [], 1
    while s <= size:
        steps.insert(0, s)
        s *= 2
    before = lambda x: x < key if strict else x <= key
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.lit(size)) & before(F.get(bounds, at + step - 1)), at + step
        ).otherwise(at),
    )
