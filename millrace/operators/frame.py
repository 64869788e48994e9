"""Dataset operations: functions that take a DataFrame and return one, for ``df.transform``.

Column checks run when the plan is built; nothing is computed before the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schema import require
from ..sources.shared import staged

Operation = Callable[[DataFrame], DataFrame]


def keep(*columns: str) -> Operation:
    """Project to ``columns``, in that order."""

    def apply(df: DataFrame) -> DataFrame:
        require(df, columns)
        return df.select(*columns)

    return apply


def drop(*columns: str) -> Operation:
    def apply(df: DataFrame) -> DataFrame:
        require(df, columns)
        return df.drop(*columns)

    return apply


def rename(mapping: dict[str, str]) -> Operation:
    """Rename all at once, so that names can be swapped."""

    def apply(df: DataFrame) -> DataFrame:
        require(df, tuple(mapping))
        return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])

    return apply


def hash_column(column: str, target: str) -> Operation:
    """Add (or replace) ``target``, the SHA-256 of ``column``."""

    def apply(df: DataFrame) -> DataFrame:
        require(df, (column,))
        return df.withColumn(target, text.sha256(F.col(column)))

    return apply


def deduplicate(*columns: str, order: str | None = None) -> Operation:
    """Keep one row for each combination of ``columns``: the first by ``order``, or else any.

    An aggregate, not a ranking: rows are combined before the shuffle, so a value that holds much
    of the table is one row per task on the wire. Ties in ``order`` go to the smallest whole row.
    Nulls are equal to each other.
    """

    def apply(df: DataFrame) -> DataFrame:
        require(df, (*columns, *([order] if order else [])))
        rest = [c for c in df.columns if c not in columns]
        if not rest:
            return df.select(*columns).distinct().select(*df.columns)
        if order is None:
            return df.dropDuplicates(list(columns))
        # maps cannot be compared, so they follow the choice instead of taking part in it
        ranked = [c for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
        if order in columns or len(ranked) < len(rest):
            by = Window.partitionBy(*columns).orderBy(order)
            return df.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")
        first = F.min(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in rest])).alias("_first")
        return df.groupBy(*columns).agg(first).select(*[F.col(c) if c in columns else F.col(f"_first.{c}").alias(c) for c in df.columns])

    return apply


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in memory, from the lengths of variable columns and the widths of others; 8 for the row itself."""
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    total = F.lit(8).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType):
            size = F.size(c) * fixed.get(type(f.dataType.elementType), 8)
        else:
            size = F.lit(fixed.get(type(f.dataType), 8))
        total = total + F.coalesce(size, F.lit(0)).cast("long")
    return total


def repartition(chunks: int | None = None, size: int | str | None = None) -> Operation:
    """Deal rows to exactly ``chunks`` partitions, or to so many that each has at most about ``size`` bytes.

    The parquet sink turns each partition into a file. By size, the rows are written to the shared folder first, so
    that what leads to them runs once; their bytes are summed there.
    """
    if (chunks is None) == (size is None):
        raise ValueError("give either chunks or size")

    def apply(df: DataFrame) -> DataFrame:
        if chunks is not None:
            return df.repartition(chunks)
        once = staged(df, "sized")
        total = once.agg(F.coalesce(F.sum(row_bytes(once)), F.lit(0))).first()[0]
        return once.repartition(1 + int(total) // text.parse_size(size))

    return apply


def compose(*operations: Operation) -> Operation:
    def apply(df: DataFrame) -> DataFrame:
        for operation in operations:
            df = operation(df)
        return df

    return apply


def hash_dedup_drop(column: str, order: str | None = None) -> Operation:
    """Drop rows that repeat ``column``, compared by a hash so that wide values are not shuffled twice."""
    return compose(hash_column(column, "_hash"), deduplicate("_hash", order=order), drop("_hash"))


def number(df: DataFrame, target: str, *order: Column | str) -> DataFrame:
    """Add ``target``, each row's place from 0 in the order of ``order``; ties are numbered in any order.

    Rows are sorted by range partitions and written once; a row's number is its place in its partition and the
    count of those before, so no task sees more than its range, and the driver only counts by partition.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each partition
    return out.withColumn(target, F.col("_before") + place).select(*[c for c in df.columns if c != target], target)
