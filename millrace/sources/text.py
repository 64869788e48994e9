"""JSON, CSV and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import number
from ..operators.link import binary_files, flatten_vulnerabilities

SAMPLES = "task_id string, prompt string, declaration string, canonical_solution string"
VULNERABILITIES = "map<string, array<struct<repo: string, cve_name: string, function_names: string, binary_version: string>>>"
ATTEMPTS = (
    "attempts array<struct<id: string, task_id: string, src_language__str: string, "
    "judgement: struct<results: array<struct<verdict: int>>>>>"
)
INDEX = "challenge struct<tasks: array<struct<id: string, title: string, statement: string>>>"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """``id, source, summary`` of a file of coding samples, an object on each line."""
    rows = spark.read.schema(SAMPLES).json(path)
    return rows.select(F.col("task_id").alias("id"), F.concat("declaration", "canonical_solution").alias("source"), F.col("prompt").alias("summary"))


def json_values(spark: SparkSession, *paths: str) -> DataFrame:
    """Every file as one JSON value: ``file, value`` (VARIANT)."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.parse_json("value").alias("value"))


def merge_json(values: DataFrame) -> DataFrame:
    """``file, pos, value`` with lists opened, one row for each item, and other values as they are."""
    items = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
    return values.select("file", F.posexplode(items).alias("pos", "value"))


def write_json_list(df: DataFrame, path: str, *order: str) -> None:
    """One file with one JSON list of all rows, in the order of ``order``; rows stream through its one writer."""
    rows = number(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(f"_{c}") for c in order]), "_at", *[f"_{c}" for c in order])
    lines = rows.select((F.col("_at") + 1).alias("_at"), F.concat(F.when(F.col("_at") > 0, ",").otherwise(""), "value").alias("value"))
    ends = df.sparkSession.createDataFrame([(0, "["), (2**62, "]")], "_at long, value string")
    lines.union(ends).orderBy("_at").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Lines of JSON in one folder."""
    df.write.mode("overwrite").json(path)


def split_json(df: DataFrame, path: str, chunks: int) -> None:
    """Lines of JSON in ``chunks`` files."""
    df.repartition(chunks).write.mode("overwrite").json(path)


def _strings(value):
    """Array of a text that is itself a JSON array, or else of the text alone."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))


def vulnerabilities(spark: SparkSession, *paths: str) -> DataFrame:
    """``project, fname, cve_name, version, ord`` from nested maps; names and versions may be lists or single."""
    raw = None  # paths in the order given, the files of one by name
    for rank, path in enumerate(paths):
        some = spark.read.text(path, wholetext=True).select(F.lit(rank).alias("rank"), F.input_file_name().alias("file"), F.from_json("value", VULNERABILITIES).alias("m"))
        raw = some if raw is None else raw.union(some)
    records = raw.select("rank", "file", F.posexplode(F.map_entries("m")).alias("k", "entry")).select("rank", "file", "k", F.posexplode("entry.value").alias("i", "r"))
    ordered = records.withColumn("ord", F.struct("rank", "file", "k", "i"))
    names, versions = F.col("r.function_names"), F.col("r.binary_version")
    return flatten_vulnerabilities(
        ordered.select(
            F.col("r.repo").alias("repo"), F.col("r.cve_name").alias("cve_name"), "ord",
            F.when(names.isNotNull(), _strings(names)).alias("function_names"), F.when(versions.isNotNull(), _strings(versions)).alias("binary_version"),
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header; types are given, never guessed, so versions stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def binaries(spark: SparkSession, path: str, max_bytes: int = 10_000_000, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``binary, project, version, filename`` of files at ``path/project/version/name``.

    Size is a filter that the source applies to the listing, so larger files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") < max_bytes)
    parts = F.split("path", "/")
    rows = files.select(
        F.element_at(parts, -3).alias("project"), F.element_at(parts, -2).alias("version"), F.element_at(parts, -1).alias("filename"),
        "length", F.col("content").alias("binary"),
    )
    return binary_files(rows, max_bytes, exclude=exclude).select("binary", "project", "version", "filename")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """``competitor, i, id, task_id, language, verdicts`` of the attempts at ``path``, a file for each competitor."""
    raw = spark.read.schema(ATTEMPTS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = raw.select(name.alias("competitor"), F.posexplode("attempts").alias("i", "a"))
    return rows.select(
        "competitor", "i", "a.id", "a.task_id", F.col("a.src_language__str").alias("language"),
        F.transform("a.judgement.results", lambda r: r["verdict"]).alias("verdicts"),
    )


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """``task_id, task`` of a challenge's index."""
    from ..functions.text import task_text

    rows = spark.read.schema(INDEX).option("multiLine", True).json(path).select(F.explode("challenge.tasks").alias("t"))
    return rows.select(F.col("t.id").alias("task_id"), task_text(F.col("t.title"), F.col("t.statement")).alias("task"))


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """``solution, source`` of the files in a folder, a name and its whole text each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("solution"), F.col("value").alias("source"))
