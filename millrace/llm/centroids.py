"""Centroid clustering by sort-means (Phillips, 2002), exact in integers.

Every vector becomes integers, so that distances, sums and ties do not depend on how rows are dealt. In a round a
vector starts from the centroid it was assigned to before. The other centroids are looked at in order of their distance from that one,
and the search ends at the first that lies strictly beyond twice the vector's distance from it: by the triangle inequality nothing
farther can be nearer, nor as near, which ties need.

Centroids are a fixed number of rows of a fixed width, so they go to every task, as does their table of distances. Vectors
are never shuffled: each round is one pass that writes the assignments beside the vectors, and sums by task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, scratch, stage
from .words import release

#: Components of a vector, centroids, rounds, and steps that a component of 1 is divided into.
WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Largest integer component: squares of differences of so many components, times four, stay within 64 bits.
LARGEST = 1 << 26
#: Vectors that are compared at once.
BLOCK = 4096


def integers(embedding: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Array of ints floor(scale * x), null where the vector has another width or a component that is null or not finite.

    A component beyond ``LARGEST`` raises, as its squared distance would not fit 64 bits.
    """
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    step = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    checked = lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(LARGEST)), step(x).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("int")
    )
    return F.when((F.size(embedding) == width) & finite, F.transform(embedding, checked))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: str = "2") -> np.ndarray:
    """The ``count`` vectors with the smallest SHA-256 of seed and id, by rising hash; ties by the vector, null ids last.

    Top rows of every task only, so the driver receives ``count`` rows.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` from ``b``."""
    d = a - b
    return np.einsum("nw,nw->n", d, d)


def sort_means(x: np.ndarray, before: np.ndarray, centers: np.ndarray, between: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of ``x`` (the smaller number of equally near ones), its squared distance, and how many distances it took.

    ``between`` has the centroids' squared distances from each other, and row c of ``order`` all centroids by distance from c.
    """
    best, near, work = before.astype(np.int64), np.empty(len(x), dtype=np.int64), 0
    for c in np.unique(before):
        rows = np.nonzero(before == c)[0]
        own = squared(x[rows], centers[c])
        # farthest first: those that still look on are a prefix, which shrinks as candidates lie farther out
        rows = rows[np.argsort(-own, kind="stable")]
        own = np.sort(own)[::-1]
        least, which, reach = own.copy(), np.full(len(rows), c), -4 * own
        work += len(rows)
        for other in order[c]:
            if other == c:
                continue
            looking = int(np.searchsorted(reach, -between[c, other], side="right"))
            if not looking:
                break
            d = squared(x[rows[:looking]], centers[other])
            work += looking
            better = (d < least[:looking]) | ((d == least[:looking]) & (other < which[:looking]))
            least[:looking] = np.where(better, d, least[:looking])
            which[:looking] = np.where(better, other, which[:looking])
        best[rows], near[rows] = which, least
    return best, near, work


def table_of(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each of them all by rising distance."""
    between = np.stack([squared(centers, c) for c in centers]) if len(centers) else np.zeros((0, 0), dtype=np.int64)
    return between, np.argsort(between, axis=1, kind="stable")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``vec_id, v`` of ``rows`` with ``cluster`` (of ``centers``) and ``distance`` (squared), searched from the ``cluster`` it had."""
    k, width = centers.shape
    shared = rows.sparkSession.sparkContext.broadcast((centers, *table_of(centers)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, between, order = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best, near, _ = sort_means(_matrix(part.column(1), width), part.column(2).to_numpy(), centers, between, order)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(best, pa.int32()), pa.array(near)], ["vec_id", "v", "cluster", "distance"])
        release()

    return rows.select("vec_id", "v", "cluster").mapInArrow(each, "vec_id long, v array<int>, cluster int, distance long")


def means(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids moved to floor(sum / count) of their vectors; those of empty clusters stay.

    A task hands on one sum for each of its clusters and components, so what is shuffled and collected has a fixed size.
    """
    k, width = centers.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            at, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for c in np.unique(at):
                own = x[at == c]
                sums[c, :width] += own.sum(axis=0)
                sums[c, width] += len(own)
        there = np.nonzero(sums[:, width])[0]
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(list(sums[there]), pa.list_(pa.int64()))], ["cluster", "s"])

    parts = rows.select("cluster", "v").mapInArrow(each, "cluster int, s array<long>").select("cluster", F.posexplode("s").alias("at", "x"))
    total = np.zeros((k, width + 1), dtype=np.int64)
    for r in parts.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        total[r["cluster"], r["at"]] = r["x"]
    count = total[:, width:]
    return np.where(count > 0, total[:, :width] // np.maximum(count, 1), centers)


def fingerprint(center: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, center.tolist())).encode()).hexdigest()


def cluster(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2", width: int = WIDTH) -> DataFrame:
    """Cluster the rows of ``embeddings`` (``vec_id, embedding``) around ``count`` centroids.

    Returns ``vec_id, cluster, distance`` (squared) ``, cluster_inertia, inertia, centroid_sha256`` of every row whose vector has
    exactly ``width`` components, none of them null or not finite; other rows are left out. Of equally near centroids the smaller
    number holds. Repeated rows are clustered each; a null vec_id is a row like others, but the last to be a first centroid. Of fewer vectors than
    ``count`` each is a first centroid. Components of 2**18 or more raise, as distances would leave 64 bits. An empty table gives an empty
    result; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), width).alias("v"))
    with scratch(spark) as kept:
        now = stage(rows.filter("v is not null").select("vec_id", "v", F.lit(0).cast("int").alias("cluster")), "vectors")
        centers = first_centroids(now, count, seed).reshape(-1, width)
        for k in range(rounds + 1):
            before, now = now, stage(assigned(now, centers), "clusters")
            drop_stage(before)
            if k < rounds:
                centers = means(now, centers)
        kept.append(now)
    sums = {r["cluster"]: r["s"] for r in now.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid at most
    about = [(c, s, sum(sums.values()), fingerprint(centers[c])) for c, s in sums.items()]
    report = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
