"""Connected components by alternating stars (Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of its closed neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``) but the least of each component.

    ``component`` is the least node reachable. Every round is written to the shared folder, and
    ends the search once it changes nothing; a path of n edges takes about log n rounds.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        new = stage(_small_star(_large_star(now)), "stars")
        drop_stage(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
