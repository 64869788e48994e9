"""What a pipeline tells of itself: rows of every stage, failures with their rows, and the workers' logs, all as data."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import Operation

#: The session setting under which Spark keeps what Python workers log.
LOGGING = "spark.sql.pyspark.worker.logging.enabled"


class Counts:
    """Rows of each stage, counted as they pass: the pipeline's own job counts, and none runs for the report.

    A stage whose tasks are repeated after an executor was lost counts those rows again, so a report of a troubled run is an upper bound.
    """

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation, list[str]]] = []

    def watch(self, name: str, **conditions: Column) -> Operation:
        """Count rows here, and those that meet each condition."""
        observation = Observation(f"{len(self.stages)} {name}")
        self.stages.append((name, observation, list(conditions)))

        def apply(df: DataFrame) -> DataFrame:
            return df.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])

        return apply

    def around(self, operations: list[Operation]) -> list[Operation]:
        """The operations with a count before the first and after each, named like them."""
        out = [self.watch("input")]
        for operation in operations:
            out += [operation, self.watch(operation.__qualname__.split(".")[0])]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``stage, name, rows, counts``; waits for the job that the stages belong to."""
        rows = []
        for k, (name, observation, conditions) in enumerate(self.stages):
            found = observation.get
            rows.append((k, name, found["rows"], {c: found[c] for c in conditions}))
        return spark.createDataFrame(rows, "stage int, name string, rows long, counts map<string, long>")


def attempt(df: DataFrame, function: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], results: str | T.StructType) -> DataFrame:
    """Apply ``function`` to each row, and keep what fails beside what succeeds.

    It gets a row as a dict and gives any number of dicts with the columns of ``results``, which go beside the row's own or replace them. ``error`` is null
    there. A row on which it raises comes back once, with null results and the exception in ``error``; what the function gave before it raised is not kept,
    so a row either succeeds or fails. A result may itself have an ``error``, for a part that was dropped. A batch is never lost for one of its rows.
    """
    fields = T.StructType.fromDDL(results).fields if isinstance(results, str) else results.fields
    names = {f.name for f in fields}
    own = [f for f in df.schema.fields if f.name not in names and f.name != "error"]
    schema = T.StructType([*own, *fields, T.StructField("error", T.StringType())])
    columns = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = logging.getLogger(__name__)
        for batch in batches:
            rows = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                kept = {f.name: row[f.name] for f in own}
                try:
                    found = [{**kept, **dict.fromkeys((*names, "error")), **one} for one in function(row)]
                except Exception as e:
                    found = [{**kept, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}]
                rows += found
            errors = [r["error"] for r in rows if r["error"] is not None]
            if errors:
                log.warning("%d of %d rows dropped, the first for %s", len(errors), len(rows), errors[0])
            if rows:
                yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})

    return df.mapInPandas(run, schema)


def divided(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What succeeded, without ``error``, and what failed. ``attempts`` should be a table, or each half makes all attempts."""
    return attempts.filter("error is null").drop("error"), attempts.filter("error is not null")


def worker_logs(spark: SparkSession) -> DataFrame:
    """``ts, level, logger, msg, context`` and more of what Python workers have logged since ``LOGGING`` was set in this session."""
    return spark.tvf.python_worker_logs()
