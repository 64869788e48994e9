"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one local process, a temporary folder
    takes its place; on a cluster that is an error, as executors would not see it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.local.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("millrace.local.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_owned: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, by when nothing may be left to compute from them."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whoever reads it, and no lost executor recomputes it."""
    path = new_path(df.sparkSession, label)
    for paths in _owned[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside; those that had no value have none again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def own_session(spark: SparkSession, values: dict[str, str]) -> SparkSession:
    """A session beside ``spark`` with its settings and ``values``: what it reads is planned by them, and ``spark`` stays as it is."""
    other = spark.newSession()
    for k, v in {**spark.conf.getAll, **values}.items():
        if spark.conf.isModifiable(k):
            other.conf.set(k, v)
    return other
