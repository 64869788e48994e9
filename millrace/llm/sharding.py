"""Sharding by sampled splitters.

Records are ordered by a key, the 64-bit hash of their text, so that equal texts stand
together. A sample of keys, drawn with a chance proportional to size, gives quantile
boundaries of many small ranges; the ranges are measured exactly, and overfull ones are
subdivided by a finer sample of their own until none is. Ranges are then dealt to shards, largest first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small, stage

#: Ranges of each shard: their size is what shards differ by at most.
RANGES_PER_SHARD = 64


def record_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, key, seq``: all that later steps read of a document. ``seq`` numbers rows by the task that read them."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _sample(rows: DataFrame, rate: float, seed: int) -> pd.DataFrame:
    """Keys, ascending, with weights ``w``: of rows drawn with the chance size * rate, each for 1, or for that where it is above 1.

    Rows of a key are summed up before they leave the executors, so copies take one place.
    """
    u = F.pmod(F.xxhash64("key", "seq", F.lit(seed)), F.lit(2**40)) / float(2**40)
    drawn = rows.filter(u < F.col("size") * F.lit(rate)).groupBy("key").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") * F.lit(rate))).alias("w"))
    return drawn.toPandas().sort_values("key", ignore_index=True)


def _cuts(sample: pd.DataFrame, step: float) -> np.ndarray:
    """Keys at which the summed weight passes a multiple of ``step``; one that weighs as much itself is cut off on both sides."""
    key, w = sample["key"].to_numpy(dtype=np.int64), sample["w"].to_numpy(dtype=float)
    upto = w.cumsum()
    heavy = key[w >= step]
    return np.unique(np.concatenate([key[np.floor(upto / step) > np.floor((upto - w) / step)], heavy, heavy[heavy < np.iinfo(np.int64).max] + 1]))


def _with_range(rows: DataFrame, bounds: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``rng``, the number of boundaries at or below the key; with ``only``, just those of these ranges."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rng = np.searchsorted(bounds, batch.column("key").to_numpy(), "right")
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(rng, pa.int64())], names=[*batch.schema.names, "rng"])
            yield out if only is None else out.filter(pa.array(np.isin(rng, only)))

    return rows.mapInArrow(find, T.StructType([*rows.schema.fields, T.StructField("rng", T.LongType())]))


def splitters(rows: DataFrame, count: int, total: int, sample_per_range: int, seed: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Boundaries of about ``count`` ranges of ``rows``, and the ranges' ``rng, s, lo, hi``; none of several texts is more than twice the fair size."""
    fair = max(1.0, total / count)
    bounds = _cuts(_sample(rows, sample_per_range / fair, seed), sample_per_range)
    while True:
        seed += 1
        sums = _with_range(rows, bounds).groupBy("rng").agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).toPandas()
        over = sums[(sums["s"] > 2 * fair) & (sums["lo"] < sums["hi"])]
        if not len(over):
            return bounds, sums
        fine = _sample(_with_range(rows, bounds, over["rng"].to_numpy()), 4 * sample_per_range / fair, seed)
        of = np.searchsorted(bounds, fine["key"].to_numpy(), "right")
        # what follows a range's least key is cut off in any case, so every pass divides each of them
        new = [_cuts(own, 4 * sample_per_range) for _, own in fine.groupby(of)] + [over["lo"].to_numpy(dtype=np.int64) + 1]
        bounds = np.unique(np.concatenate([bounds, *new]))


def shard(docs: DataFrame, shards: int = 8, sample_per_range: int = 24, seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, rng, shard, slot`` for every row of ``docs``.

    The law is that shards have nearly equal sums of ``size`` (UTF-8 bytes of the text plus
    one). Equal texts share a shard, as long as their rows fit one: a text that is larger than
    a fair shard is divided by a hash of its rows. ``slot`` counts a shard's rows from 0 without gaps.

    Null text counts as none (size 1) and as equal to the empty one. Rows are told apart by where they were read, so doc_id
    may be null or repeat. Ties between texts of one hash, and between equally large ranges, go by hash and number. An
    empty table gives an empty result. Extra columns are ignored, and a text's length matters by its size alone.

    The driver holds about ``RANGES_PER_SHARD`` boundaries a shard and ``sample_per_range`` keys of each. Nothing else leaves
    the executors: slots come from counts by reading task and shard, so neither a text nor a range is one task's.
    """
    with scratch(docs.sparkSession) as kept:
        rows = stage(record_columns(docs), "shard-rows")
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        count = shards * RANGES_PER_SHARD
        bounds, sums = splitters(rows, count, total, sample_per_range, seed)
        # texts larger than a shard, each alone in its range, are divided in parts of a range's size
        large = sums[sums["s"] > total / shards]
        parts = np.ones(len(bounds) + 1, dtype=np.int64)
        parts[large["rng"].to_numpy(dtype=int)] = [math.ceil(s * count / total) if lo == hi else 1 for s, lo, hi in large[["s", "lo", "hi"]].itertuples(index=False)]
        first = np.cumsum(parts) - parts
        in_parts = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(2**31))

        def find_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rng = np.searchsorted(bounds, batch.column("key").to_numpy(), "right")
                unit = first[rng] + batch.column("u").to_numpy() % parts[rng]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rng, pa.int64()), pa.array(unit, pa.int64())], names=[*batch.schema.names, "rng", "unit"])

        keyed = rows.withColumn("u", in_parts)
        units = stage(keyed.mapInArrow(find_unit, T.StructType([*keyed.schema.fields, T.StructField("rng", T.LongType()), T.StructField("unit", T.LongType())])).drop("u", "key"), "shard-units")
        sizes = units.groupBy("unit").agg(F.sum("size").alias("s")).toPandas().sort_values(["s", "unit"], ascending=[False, True])
        heap, plan = [(0, k) for k in range(shards)], []
        for r in sizes.itertuples(index=False):
            size, k = heapq.heappop(heap)
            plan.append((int(r.unit), k))
            heapq.heappush(heap, (size + int(r.s), k))
        dealt = docs.sparkSession.createDataFrame(plan, "unit long, shard int")
        # as many rows as units: a few hundred a shard, and those of divided texts
        placed = stage(units.join(F.broadcast(dealt), "unit").withColumn("part", F.shiftright("seq", 33)).drop("unit"), "shard-placed")
        counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = stage(counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before")), "shard-starts")
        inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("seq"))
        kept.append(
            stage(
                placed.join(small(starts), ["shard", "part"])
                .withColumn("slot", (F.col("before") + inside - 1).cast("long"))
                .select("doc_id", "size", "text_crc32", "rng", "shard", "slot"),
                "shard-slots",
            )
        )
    return kept[0]


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write ``docs`` as ``path/shard=k`` folders by :func:`shard`, and return the placement.

    Rows are matched by doc_id, which must be unique.
    """
    placed = shard(docs, shards)
    docs.join(placed.select("doc_id", "shard"), "doc_id").write.partitionBy("shard").parquet(path)
    return placed
