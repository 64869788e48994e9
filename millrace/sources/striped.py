"""A parquet dataset as training readers take it: whole files, by name, in turn.

A Python data source that plans one partition for each reader: of the files by name, reader k of n gets each n-th from the
k-th on, and gives its rows file by file, in their order. Files are read in batches, so a task holds one batch however large a file is; row groups that
cannot meet a filter are passed over by their statistics.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import PathDoesNotExist
from ..schema import Schema, validate

#: What a row can carry besides its columns: its reader, its file's name, and its place there.
PLACE = T.StructType().add("reader", T.IntegerType()).add("file", T.StringType()).add("place", T.LongType())


def _open(path: str):
    """File system and path of a URI or a local path."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def listing(path: str) -> list[str]:
    """Data files at ``path`` by name: those of a folder, or the one file that it is."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = _open(path)
    info = fs.get_file_info(root)
    if info.type == FileType.NotFound:
        raise PathDoesNotExist(path)
    if info.type == FileType.File:
        return [root]
    return sorted(x.path for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.File and x.base_name[0] not in "._")


@dataclass
class Stripe(InputPartition):
    """The files of one reader."""

    reader: int
    files: tuple[str, ...]


#: Least and greatest value of a row group that can meet a filter. Values of other types are not compared: a float column may hold NaN, which no statistic shows.
_ORDERED = (int, str, datetime.date)
_MEETS = {
    EqualTo: lambda lo, hi, v: lo <= v <= hi,
    In: lambda lo, hi, v: any(lo <= x <= hi for x in v),
    GreaterThan: lambda lo, hi, v: hi > v,
    GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
    LessThan: lambda lo, hi, v: lo < v,
    LessThanOrEqual: lambda lo, hi, v: lo <= v,
}


def can_meet(group: pq.RowGroupMetaData, names: dict[str, int], filters: list[Filter]) -> bool:
    """Whether a row group may hold a row that all ``filters`` let through; true where its statistics do not tell."""
    for f in filters:
        at = names.get(f.attribute[0])
        stats = group.column(at).statistics if at is not None and len(f.attribute) == 1 else None
        values = f.value if isinstance(f, In) else (f.value,)
        if stats is None or not stats.has_min_max:
            continue
        if all(type(x) in _ORDERED and type(x) is type(stats.min) for x in values) and not _MEETS[type(f)](stats.min, stats.max, f.value):
            return False
    return True


class StripedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.readers = options["path"], int(options.get("readers", "1"))
        if self.readers < 1:
            raise ValueError("readers must be at least 1")
        self.only = int(options["worker"]) if "worker" in options else None
        self.rows = int(options.get("batch", "4096"))
        self.arrow = to_arrow_schema(schema)
        self.filters: list[Filter] = []

    def partitions(self) -> list[Stripe]:
        found = listing(self.path)
        stripes = [Stripe(k, tuple(found[k :: self.readers])) for k in range(self.readers)]
        return stripes if self.only is None else stripes[self.only : self.only + 1]

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        own = [f for f in self.arrow if f.name not in PLACE.names]
        fs, _ = _open(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as raw:
                file = pq.ParquetFile(raw)
                at = 0
                for g in range(file.num_row_groups):
                    group = file.metadata.row_group(g)
                    names = {group.column(k).path_in_schema: k for k in range(group.num_columns)}
                    if can_meet(group, names, self.filters):
                        place = at
                        for batch in file.iter_batches(self.rows, row_groups=[g], columns=[f.name for f in own], use_threads=False):
                            n = batch.num_rows
                            columns = {f.name: batch.column(f.name).cast(f.type) for f in own}
                            columns |= {"reader": pa.array([partition.reader] * n, pa.int32()), "file": pa.array([path.rpartition("/")[2]] * n, pa.string()), "place": pa.array(range(place, place + n), pa.int64())}
                            yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.arrow], schema=self.arrow)
                            place += n
                    at += group.num_rows


class PruningReader(StripedReader):
    """With filters: Spark applies them too, as statistics only tell what cannot meet them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        self.filters = [f for f in filters if type(f) in _MEETS and f.attribute[0] not in PLACE.names]
        return iter(filters)


class Striped(DataSource):
    """``spark.read.format("striped")``; the schema has to be given. Options: ``readers``, ``worker`` (only this one), ``batch``, ``prune``."""

    @classmethod
    def name(cls) -> str:
        return "striped"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PruningReader if self.options.get("prune") == "true" else StripedReader)(schema, dict(self.options))


def read_striped(spark: SparkSession, path: str, readers: int = 1, worker: int | None = None, columns: tuple[str, ...] | None = None, schema: Schema | None = None, place: bool = False, batch: int = 4096) -> DataFrame:
    """Rows of a dataset or file, a partition for each of ``readers``: each row once, files by name, rows in order.

    With ``worker``, only that reader's; a reader beyond the number of files has no rows. Only ``columns`` are read. ``schema`` is checked on the first
    file, which stands for all. With ``place``, rows carry ``reader, file, place``. Where ``spark.sql.python.filterPushdown.enabled`` is set, filters pass over row groups.
    """
    first = listing(path)[:1]
    found = spark.read.parquet(path) if first else spark.createDataFrame([], "id string")
    if schema is not None:
        validate(found, schema)
    kept = found.select(*columns).schema if columns else found.schema
    if clash := set(PLACE.names) & set(kept.names):
        raise ValueError(f"columns {sorted(clash)} have names of places")
    spark.dataSource.register(Striped)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = spark.read.format("striped").schema(T.StructType([*kept.fields, *(PLACE.fields if place else ())])).options(readers=readers, batch=batch, prune=prune)
    return (source if worker is None else source.option("worker", worker)).load(path)
