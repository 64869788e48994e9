"""Filter interaction audit by direct relational replay.

Which filter removes a document depends on the order of filters. Each document's failures are five bits. They meet all 120 orders, a table of fixed
size that is broadcast, and each order's five steps are exploded. A step knows the bits of the steps before it, so the first failure is a
comparison of bits, and what the step does to the document is summed under conditions: in each task first, so that what is
shuffled are 600 rows for each part and task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small, stage

#: The filters, by their bits.
FILTERS = "ABCDE"
#: Documents that one task replays: 600 steps each.
DOCUMENTS = 20_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text_digest, bits``: which of the filters that look at one text alone fail it (A to D)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = own.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_digest"), words(F.col("text")).alias("w"), F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.col("text").rlike("[#$%&*|]").alias("symbol"),
    )
    n, distinct = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    fails = (n < 100, distinct * 100 < n * 80, F.col("n_upper").cast("long") * 100 > F.col("n_chars").cast("long") * 10, F.col("symbol"))
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return counted.select("doc_id", "part", "text_digest", bits.alias("bits"))


def repeats(rows: DataFrame) -> DataFrame:
    """``text_digest, first_id`` of every text that several ids have; copies are combined in each task before they meet."""
    return rows.groupBy("text_digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("text_digest", "first_id")


def orders(spark: SparkSession) -> DataFrame:
    """``filter_order, steps``: all orders of the filters, each with its steps (``step, own, before``: the bits of a filter and of those before it)."""
    rows = []
    for p in permutations(FILTERS):
        own = [1 << FILTERS.index(x) for x in p]
        rows.append(("".join(p), [(k + 1, own[k], sum(own[:k])) for k in range(len(own))]))
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, own: int, before: int>>")


def replay(rows: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and ``COUNTS`` of documents (``part, bits, good, toxic``) under every order."""
    steps = rows.crossJoin(F.broadcast(orders(rows.sparkSession))).select("part", "bits", "good", "toxic", "filter_order", F.explode("steps").alias("s"))
    bits, own, before = F.col("bits"), F.col("s.own"), F.col("s.before")
    fails, passed = bits.bitwiseAND(own) != 0, bits.bitwiseAND(before) == 0  # passed: no filter before this one removed it
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", F.col("s.step").alias("step")).agg(
        count(passed & ~fails).alias("kept"),
        count(passed & fails).alias("removed"),
        count(~passed & fails).alias("redundant"),
        count(bits == own).alias("unique_fails"),
        count(passed & fails & F.col("good")).alias("good_lost"),
        count(passed & fails & F.col("toxic")).alias("toxic_lost"),
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """``counts`` with ``shapley``: what a step's filter removed of its part, summed over all orders, 120 rows each."""
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", own)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what each filter does in each of 120 orders.

    ``docs`` has ``doc_id, text, lang``; ``labels`` has ``doc_id, quality, toxic``. A part is a lang value, null lang the empty string. Null text is
    empty: it fails A, and E if a smaller id has no text either. Filters look at whole texts, however long. Rows that repeat a doc_id count each, and are no
    duplicates of each other; a null doc_id is smaller than none, so it fails E never. A document is good if any of its labels has quality 1, toxic
    if any has toxic 1; labels that are null or without a document count nothing. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        rows = stage(failures(docs), "audit-failures")
        first = stage(repeats(rows), "audit-repeats")
        known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        known = stage(known.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good or toxic"), "audit-labels")
        # both sides are tables as they lie, so what one text or id holds much of can be split; within a stated bound the smaller is broadcast
        joined = rows.join(small(first, 200_000), "text_digest", "left").join(small(known, 200_000), "doc_id", "left")
        again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
        flags = joined.select(
            "part", (F.col("bits") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("bits"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
        )
        # a document is a few bytes that become 600 rows, so tasks are sized by documents
        counts = stage(replay(flags.repartition(1 + rows.count() // DOCUMENTS)), "audit-counts")
        kept.append(counts)
    return with_shares(counts).select("part", "filter_order", "step", *COUNTS, "shapley")
