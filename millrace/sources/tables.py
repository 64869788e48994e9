"""The service's tables in Spark's catalog, bucketed by the user, so that completions meet their users without a shuffle.

A table is a folder of versions. A change writes the next version whole and is seen once that is complete; readers keep the version that they
began with, and of two writers of one version the second fails. Both tables have the same number of buckets by the same key, which their join and
the report by user need. Where one user holds a large part of all rows, read with ``spark.sql.sources.bucketing.enabled`` off: then
joins shuffle, and adaptive execution splits that user.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import PathDoesNotExist, PathExists
from ..schema import require
from .parquet import _path, complete, exists

#: Columns of each table, and the column of the user's id.
TABLES = {
    "user": ("id BIGINT, username STRING, admin BOOLEAN", "id"),
    "completion": ("id BIGINT, user_id BIGINT, type INT, input STRING, output STRING, timestamp TIMESTAMP_NTZ, state INT, rating INT, comments STRING", "user_id"),
}


class Tables:
    """The tables below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.database = f"millrace_{zlib.crc32(self.folder.encode()):08x}"

    def _versions(self, name: str) -> list[tuple[int, int]]:
        """Complete versions of a table, each with its number of buckets."""
        root = f"{self.folder}/{name}"
        if not exists(self.spark, root):
            return []
        fs, p = _path(self.spark, root)
        found = [re.fullmatch(r"v(\d+)-b(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted((int(m[1]), int(m[2])) for m in found if m and complete(self.spark, f"{root}/{m[0]}"))

    def _place(self, name: str, version: int, buckets: int) -> tuple[str, str]:
        return f"{self.folder}/{name}/v{version}-b{buckets}", f"{self.database}.{name}_v{version}"

    def _database(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.folder}/catalog'")

    def initialize(self, buckets: int = 64) -> None:
        """Create empty tables; it is an error if there are any."""
        if exists(self.spark, self.folder):
            raise PathExists(self.folder)
        for name, (columns, _) in TABLES.items():
            self._write(name, self.spark.createDataFrame([], T.StructType.fromDDL(columns)), 0, buckets)

    def destroy(self) -> None:
        """Drop the tables and delete all that they held."""
        if not exists(self.spark, self.folder):
            raise PathDoesNotExist(self.folder)
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        fs, p = _path(self.spark, self.folder)
        fs.delete(p, True)

    def table(self, name: str) -> DataFrame:
        """The last complete version, declared with its buckets in this session's catalog."""
        versions = self._versions(name)
        if not versions:
            raise PathDoesNotExist(f"{self.folder}/{name}")
        (columns, key), (version, buckets) = TABLES[name], versions[-1]
        place, known = self._place(name, version, buckets)
        self._database()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(known)

    def _write(self, name: str, df: DataFrame, version: int, buckets: int) -> None:
        columns, key = TABLES[name]
        schema = T.StructType.fromDDL(columns)
        require(df, tuple(schema.names))
        place, known = self._place(name, version, buckets)
        if exists(self.spark, place):
            raise PathExists(f"{place}: another writer was first")
        self._database()
        self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        rows = df.select(*[df[f.name].cast(f.dataType) for f in schema]).repartition(buckets, key)  # a file for each bucket
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", place).format("parquet").saveAsTable(known)

    def replace(self, name: str, df: DataFrame) -> None:
        """The next version of a table; ``df`` may be made of the last. The version before the last is deleted."""
        versions = self._versions(name)
        if not versions:
            raise PathDoesNotExist(f"{self.folder}/{name}")
        version, buckets = versions[-1]
        self._write(name, df, version + 1, buckets)
        for old, b in versions[:-1]:
            place, known = self._place(name, old, b)
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
            fs, p = _path(self.spark, place)
            fs.delete(p, True)
