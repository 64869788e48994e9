"""Mixing sources to target weights by hash-threshold histograms (built-in functions only).

Every document gets a 48-bit hash of its id. Tokens are summed by source and hash
bucket; the bucket in which a source's budget runs out is the only one that is
refined, by the other digits of the hash, so that the threshold lies between two
documents. A document is then taken by comparing its hash with its source's
threshold: nothing is sorted, and what is shuffled are bucket sums.

A whole-copy threshold leaves less than one document of budget over. Nested
thresholds spend it: the same search runs again over the documents that fit what
is left, a few times, so that a source ends within a few short documents of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, scratch, small, stage, word_count

#: Hexadecimal digits of the hash, and those that tell a source's buckets apart: one in 65,536 of its documents is looked at again.
LENGTH, DIGITS = 12, 4
#: Sources up to which their table goes to all rows, so that a source of a third of the rows is in no one task.
MOST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, budget: float = 1.0) -> DataFrame:
    """One row per source: ``sid, source, source_size, target``.

    ``sizes`` has ``source, source_size``. Sources in code-point order, null last,
    take ``weights`` in turn, and share ``budget`` times the total by weight. A target stops
    at ``max_epochs`` times its source's size; the excess goes to the others by weight.

    That fixed point is found in closed form: with sources in ascending order of
    cap/weight, those before the first source whose cap is at least its share of
    what the earlier ones leave are capped. Source-level rows only (a handful).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("all_w", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    )
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    return ranked.withColumn("level", free["level"]).select(
        "sid", "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def hash_digits(doc_id: Column, seed: str = "mix") -> Column:
    """Twelve hexadecimal digits that stand for the document in every rerun."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, LENGTH)


def _first_over(sums: DataFrame) -> DataFrame:
    """Per source the first bucket of ``sums`` (``sid, rest, used, bucket, n``) at which what is used no longer fits the rest: ``sid, bucket, upto``.

    ``upto`` is what is used before it. A source has at most as many buckets as the digits of a level tell apart, so no task cumulates more.
    """
    upto = F.col("used") + F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("upto") <= F.col("rest")
    return sums.withColumn("upto", upto).groupBy("sid").agg(F.min(F.when(~fits, F.col("bucket"))).alias("bucket"), F.max(F.when(fits, F.col("upto"))).alias("upto"))


def _taken(rounds: list[int]) -> Column:
    """Whether one of the rounds took a document."""
    out = F.lit(False)
    for k in rounds:
        out = out | ((F.col("size") <= F.col(f"b{k}")) & (F.col("h") < F.col(f"t{k}")))
    return out


def plan_of(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, budget: float = 1.0, rounds: int = 4) -> DataFrame:
    """One row per source of ``rows`` (``source, size, h``), a staged table: ``source, source_size, target, whole`` and each round's ``b, t``.

    All documents of a source are taken ``whole`` times; one more copy is taken of those that are in a round no larger than its budget ``b`` and below its
    threshold ``t``, the smallest hash that no longer fits. A round scans the rows twice: for sums by the first digits of the hash, and for sums by
    all digits in the one bucket of each source where its budget runs out. Both join the plan so far, a row for each source.
    """
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stage(targets.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-targets")
    mark = F.broadcast if plan.count() <= MOST_SOURCES else lambda df: df
    for k in range(rounds):
        open_rows = lambda more: rows.join(mark(more), rows["source"].eqNullSafe(more["plan_source"])).filter((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~_taken(list(range(k))))  # noqa: E731, B023
        known = plan.select(F.col("source").alias("plan_source"), "sid", "rest", *[f"{x}{j}" for j in range(k) for x in "bt"])
        head = F.substring("h", 1, DIGITS)
        coarse = open_rows(known).groupBy("sid", "rest", F.lit(0).cast("long").alias("used"), head.alias("bucket")).agg(F.sum("size").alias("n"))
        first = stage(_first_over(coarse).select("sid", F.col("bucket").alias("edge"), F.coalesce("upto", F.lit(0)).alias("used")), "mix-level")
        edges = known.join(mark(first.filter("edge is not null")), "sid")
        fine = _first_over(open_rows(edges).filter(head == F.col("edge")).groupBy("sid", "rest", "used", F.col("h").alias("bucket")).agg(F.sum("size").alias("n")))
        found = first.join(mark(fine.select("sid", "bucket", "upto")), "sid", "left")
        # 'g' sorts after every digit: where nothing is over the budget, all documents fit
        found = found.select("sid", F.coalesce("bucket", F.lit("g")).alias(f"t{k}"), F.coalesce("upto", "used").alias("spent"))
        more = plan.join(mark(found), "sid", "left").select(
            *[c for c in plan.columns if c != "rest"], F.col("rest").alias(f"b{k}"), F.coalesce(f"t{k}", F.lit("g")).alias(f"t{k}"), (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("rest")
        )
        plan = stage(more.drop("sid", "rest") if k == rounds - 1 else more, "mix-plan")
    return plan


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source, size, h``) with ``source_size, target, copies`` of the plan; no text and no row is shuffled but for very many sources."""
    rounds = sorted(c[1:] for c in plan.columns if c[0] == "b" and c[1:].isdigit())
    named = small(plan.withColumnRenamed("source", "plan_source"), MOST_SOURCES)
    copy = F.lit(0)
    for k in rounds:
        copy = F.when((F.col("size") <= F.col(f"b{k}")) & (F.col("h") < F.col(f"t{k}")), 1).otherwise(copy)
    copies = (F.col("whole") + F.when(F.col("size") > 0, copy).otherwise(0)).cast("long")
    joined = rows.join(named, rows["source"].eqNullSafe(named["plan_source"]))
    return joined.withColumn("copies", copies).drop("plan_source", "whole", *[f"{x}{k}" for x in "bt" for k in rounds])


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "source", word_count(F.col("text")).alias("size"), hash_digits(F.col("doc_id")).alias("h"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text, source``) with its part in the mix; ``options`` are those of :func:`plan_of`.

    Returns ``doc_id, source, size, source_size, target, copies, taken``: the
    document is taken ``copies`` times (0 to ``max_epochs``), which is ``taken = copies * size`` words.
    All documents of a source are taken floor(target / source_size) times; the
    rest of the target takes one more copy of those below the thresholds.

    Null text has size 0 and an empty document takes part with 0 words. Null
    sources form one source, the last. Rows that repeat a doc_id share its hash: of those of one source with
    equal sizes all are taken or none. Whole texts count, however long. An empty table gives an empty result.
    Extra columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        rows = stage(_sized(docs, "doc_id"), "mix-sizes")
        plan = plan_of(rows, **options)
        kept += [rows, plan]
    return _planned(rows, plan).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, whatever its columns, repeated as often as :func:`mix` takes it."""
    spark = docs.sparkSession
    with scratch(spark) as kept:
        plan = plan_of(stage(_sized(docs), "mix-sizes"), **options)
        kept.append(plan)
    rows, back = aside(docs, "doc_id", "text", "source")
    rows = rows.withColumn("size", word_count(F.col("text"))).withColumn("h", hash_digits(F.col("doc_id")))
    return back(_planned(rows, plan).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
