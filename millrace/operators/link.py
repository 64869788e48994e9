"""Joins and lookups that link functions, vulnerabilities, attempts and solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import require
from ..sources.shared import staged
from .frame import number, row_bytes

#: Fixed value: a vulnerability of all versions.
ANY_VERSION = "-"
#: Rows of a lookup table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes that they may have.
BROADCAST_BYTES = 64 << 20


def flatten_vulnerabilities(records: DataFrame) -> DataFrame:
    """``project, fname, cve_name, version, ord`` from nested records.

    ``records`` has ``repo, cve_name, function_names array<string>, binary_version array<string>`` and
    ``ord``, the order of the records (a number, or a struct of numbers). One row for each name and version; without versions
    one with ``-``; without names none.
    """
    versions = F.when(F.col("binary_version").isNull(), F.array(F.lit(ANY_VERSION))).otherwise(F.col("binary_version"))
    return (
        records.filter("function_names is not null")
        .select("repo", "cve_name", "ord", F.posexplode("function_names").alias("i", "name"), versions.alias("versions"))
        .select("repo", "cve_name", "ord", "i", "name", F.posexplode("versions").alias("j", "version"))
        .select(
            F.col("repo").alias("project"),
            text.normalized(F.col("name")).alias("fname"),
            "cve_name",
            "version",
            F.struct("ord", "i", "j").alias("ord"),
        )
    )


def link_vulnerabilities(functions: DataFrame, vulnerabilities: DataFrame, key: str = "id") -> DataFrame:
    """Add ``vulnerability``: distinct names, in table order, of those that match project, name and version, joined by ``-``.

    Names match in lower case without white space around; a version of ``-`` matches all. The join is on project and
    name, with the version as a residual condition. No match gives an empty string.

    Names are gathered over distinct (project, name, version) triples, not over functions, so that a
    function's bytes never pass through an aggregate. As many functions may share few triples, they are not dealt out by them either:
    the gathered names are staged, and sent along while they are few. Vulnerabilities are reduced to the first of each
    name before they meet a triple, and dealt out before that, as this sorts what a task holds.
    """
    require(functions, ("project", "name", "version"))
    require(vulnerabilities, ("project", "fname", "cve_name", "version", "ord"))
    f = functions.withColumn("_fname", text.normalized(F.col("name")))
    wanted = f.select(F.col("project").alias("p"), F.col("_fname").alias("n"), F.col("version").alias("v")).distinct()
    c = vulnerabilities.select(F.col("project").alias("cp"), F.col("fname").alias("cn"), F.col("version").alias("cv"), "cve_name", "ord")
    spread = c.repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), *c.columns)
    c = spread.groupBy("cp", "cn", "cv", "cve_name").agg(F.min("ord").alias("ord"))
    met = wanted.join(c, (F.col("p") == F.col("cp")) & (F.col("n") == F.col("cn")) & ((F.col("v") == F.col("cv")) | (F.col("cv") == ANY_VERSION)))
    first = met.groupBy("p", "n", "v", "cve_name").agg(F.min("ord").alias("ord"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cve_name"))), lambda x: x["cve_name"])
    found = staged(first.groupBy("p", "n", "v").agg(F.array_join(names, "-").alias("_vulnerability")), "vulnerabilities")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(row_bytes(found)), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    same = (F.col("project") == F.col("p")) & (F.col("_fname") == F.col("n")) & (F.col("version") == F.col("v"))
    return f.join(found, same, "left").withColumn("vulnerability", F.coalesce("_vulnerability", F.lit(""))).drop("p", "n", "v", "_fname", "_vulnerability")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; an aggregate, so long histories shrink before the shuffle. Ties go to the largest row."""
    require(df, (*keys, order))
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def all_attempts(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows with their number within the key, from 0."""
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


#: Languages whose attempts are kept.
LANGUAGES = ("C", "CPP")


def supported(language: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    return language.isin(*languages)


def all_pass(results: Column) -> Column:
    """Whether every verdict is 1; a missing verdict fails, and no results pass."""
    return F.forall(results, lambda x: F.coalesce(x, F.lit(0)) == 1)


def solution_name(competitor: Column, attempt: Column, language: Column) -> Column:
    return F.concat_ws(".", competitor, attempt.cast("string"), F.lower(language))


def with_solutions(attempts: DataFrame, solutions: DataFrame) -> DataFrame:
    """Attempts that have a solution file, with its text; others go."""
    require(attempts, ("solution",))
    return attempts.join(solutions.select("solution", "source"), "solution")


def with_tasks(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every attempt with its task's text; an unknown task raises when the row is computed."""
    known = tasks.select("task_id", F.col("task").alias("_task"))
    missing = F.raise_error(F.concat(F.lit("unknown task "), F.col("task_id").cast("string")))
    return attempts.join(known, "task_id", "left").withColumn("task", F.coalesce("_task", missing.cast("string"))).drop("_task")


def present(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``other``."""
    return df.join(other.select(key), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.join(other.select(key), key, "left_anti")


#: Architectures that are disassembled.
ARCHITECTURES = ("i686", "x86_64")
#: Projects that are left out of the vulnerable binaries.
EXCLUDED = ("libpcap", "coreutils", "ffmpeg", "libtiff")


def binary_files(df: DataFrame, max_bytes: int = 10_000_000, architectures: tuple[str, ...] = ARCHITECTURES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``max_bytes`` of an included architecture (second part of the name) and no excluded project."""
    require(df, ("project", "filename", "length"))
    out = df.filter((F.col("length") < max_bytes) & F.get(F.split("filename", "-"), 1).isin(*architectures))
    return out.filter(~F.col("project").isin(*exclude)) if exclude else out


def sequential_id(df: DataFrame, order: str) -> DataFrame:
    """Add ``id``, the row's place in the order of ``order``, as text."""
    return number(df, "id", order).withColumn("id", F.col("id").cast("string"))
