"""Splits and stripes."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import require
from .sequence import uniform


def parse_split(value: str) -> tuple[str, float]:
    """``name:percent``."""
    name, sep, percent = value.partition(":")
    try:
        if not (sep and name):
            raise ValueError
        return name, float(percent)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{value!r} is not name:percent") from None


def parse_rename(value: str) -> tuple[str, str]:
    """``old:new``."""
    old, sep, new = value.partition(":")
    if not (sep and old and new) or ":" in new:
        raise argparse.ArgumentTypeError(f"{value!r} is not old:new")
    return old, new


def _shares(splits: dict[str, float]) -> list[tuple[str, float, float]]:
    if abs(sum(splits.values()) - 100) > 1e-6:
        raise ValueError("percentages must sum to 100")
    out, at = [], 0.0
    for name, percent in splits.items():
        out.append((name, at / 100, (at + percent) / 100))
        at += percent
    return out


def split_name(key: Column, splits: dict[str, float], seed: int = 42) -> Column:
    """Name of the split a key falls in, by a hash: the same however the data are partitioned."""
    u, out = uniform(F.lit(seed), key), None
    shares = _shares(splits)
    for name, _, upto in shares[:-1]:
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def hash_split(df: DataFrame, splits: dict[str, float], key: str = "id", seed: int = 42) -> dict[str, DataFrame]:
    """Disjoint and complete parts. Rows with equal keys stay together."""
    require(df, (key,))
    named = df.withColumn("_split", split_name(F.col(key), splits, seed))
    return {name: named.filter(F.col("_split") == name).drop("_split") for name in splits}


def random_split(df: DataFrame, splits: dict[str, float], seed: int = 42) -> dict[str, DataFrame]:
    """Parts by Spark's random numbers, which depend on the partitioning."""
    shares = _shares(splits)
    return dict(zip(splits, df.randomSplit([b - a for _, a, b in shares], seed), strict=True))


def write_splits(df: DataFrame, output: str, splits: dict[str, float], key: str = "id", seed: int = 42) -> dict[str, str]:
    """Write each part to ``{output}-{name}``, all or none: if any is complete already, nothing is written."""
    from ..sources.parquet import complete, write

    paths = {name: f"{output}-{name}" for name in splits}
    parts = hash_split(df, splits, key, seed)
    if not any(complete(df.sparkSession, p) for p in paths.values()):
        for name, part in parts.items():
            write(part, paths[name])
    return paths


def stripe(df: DataFrame, order: str, worker: int, workers: int) -> DataFrame:
    """Rows of the files (values of ``order``) that reader ``worker`` of ``workers`` gets, in turn by name."""
    rank = F.dense_rank().over(Window.orderBy(order)) - 1
    files = df.select(order).distinct().withColumn("_rank", rank).filter(F.col("_rank") % workers == worker).drop("_rank")
    return df.join(files, order, "left_semi")


def generate_numbers(spark: SparkSession, size: int = 64, seed: int = 42) -> DataFrame:
    """``id, number``: integers from 1 to 4096 that depend on id and seed."""
    return spark.range(size).select("id", (F.floor(uniform(F.lit(seed), F.col("id")) * 4096).cast("int") + 1).alias("number"))


def reciprocal(number: Column) -> Column:
    """1 / number; zero raises, as in the language at large."""
    return F.lit(1.0) / number
