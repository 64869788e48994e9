"""Tables of the service's database, read and written in parallel over JDBC.

A scan is cut into ranges of a key, one connection each, and filters and columns go to the database as SQL, so that neither
the driver nor one connection carries a table. Any driver on Spark's class path will do; a process of its own may use the Derby that Spark ships.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Text columns of a table get this type unless told otherwise: databases compare and index them, other than large objects.
TEXT = "VARCHAR(4096)"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?")


def reachable(spark: SparkSession) -> bool:
    """Whether :func:`database` has one: named by ``millrace.jdbc.url``, or in the memory of a local process."""
    master = spark.sparkContext.master
    return bool(spark.conf.get("millrace.jdbc.url", None)) or (master.startswith("local") and not master.startswith("local-cluster"))


def database(spark: SparkSession, name: str) -> str:
    """The URL named by ``millrace.jdbc.url``, or of a database in the memory of this process.

    Executors of a cluster do not share a process, so there it has to be set.
    """
    if not reachable(spark):
        raise ValueError("set millrace.jdbc.url to a database that all executors reach")
    found = spark.conf.get("millrace.jdbc.url", None)
    return found or f"jdbc:derby:memory:{_checked(name)};create=true"


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no plain name")
    return name


def write_table(df: DataFrame, url: str, table: str, connections: int = 8, mode: str = "overwrite", types: dict[str, str] | None = None, batch: int = 5000) -> None:
    """Write ``df`` over at most so many connections, in batches; ``types`` are column types of the database.

    A task that is tried again repeats its transaction, not a part of it; a table with a primary key refuses what was committed before.
    """
    kinds = {c: TEXT for c, t in df.dtypes if t == "string"} | (types or {})
    out = df.write.format("jdbc").options(url=url, dbtable=_checked(table), numPartitions=connections, batchsize=batch, isolationLevel="READ_COMMITTED")
    if kinds:
        out = out.option("createTableColumnTypes", ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
    out.mode(mode).save()


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, connections: int = 8, fetch: int = 10_000) -> DataFrame:
    """A table, by ``key`` (whole numbers, dates or times) in ranges of equal width between its least and greatest value.

    The bounds come from the database as one row; they only divide the rows, and null keys are in the first range. Without a key, or if all keys are
    null, one connection reads all. Filters and column lists of the plan become part of each range's SQL.
    """
    source = spark.read.format("jdbc").options(url=url, dbtable=_checked(table), fetchsize=fetch, pushDownPredicate="true", preferTimestampNTZ="true")
    if key is None:
        return source.load()
    ends = spark.read.format("jdbc").options(url=url, query=f'SELECT min("{_checked(key)}") AS lo, max("{key}") AS hi FROM {table}', preferTimestampNTZ="true").load().first()
    if ends[0] is None:
        return source.load()
    lo, hi = (str(x) for x in ends)
    return source.options(partitionColumn=f'"{key}"', lowerBound=lo, upperBound=hi, numPartitions=connections).load()
