"""Run operations from dataset to dataset."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.frame import Operation, compose
from ..operators.report import Counts
from ..sources import parquet
from ..sources.shared import scratch


def modify(spark: SparkSession, source: str | list[str], output: str, operations: list[Operation], compression: str = "uncompressed", chunks: int | None = None, size: int | str | None = None, counts: Counts | None = None) -> list[str]:
    """Read ``source``, apply ``operations`` in order, write ``output`` and return its files.

    An output that is complete is left as it is; one that an earlier run did not finish is written anew. With
    ``chunks``, exactly so many files are written, some of them empty if rows are fewer; with ``size``, files of at most so many bytes. ``counts``
    receives the rows before the first operation and after each, counted by the job that writes.
    """
    if chunks is not None and size is not None:
        raise ValueError("give either chunks or size")
    df = parquet.read(spark, source)
    if parquet.complete(spark, output):
        return parquet.files(spark, output)
    with scratch(spark):
        df = compose(*(operations if counts is None else counts.around(operations)))(df)
        if chunks is not None:
            df = df.repartition(chunks)
        return parquet.write(df, output, compression, files_exactly=chunks, size=size)
