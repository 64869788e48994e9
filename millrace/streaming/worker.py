"""The inference worker as a stream: requests arrive as files, answers leave as a dataset."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators.service import COMPLETE, QUEUED


def answer(requests: DataFrame, infer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Queued requests with ``output`` and complete; where inference fails, its error is the output."""
    rows = requests.filter(F.col("state") == QUEUED).withColumn("input", text.sanitize(F.col("input")))
    if infer is None:
        out = text.strip_padding(F.col("input"))
    else:

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            def one(v: str) -> str:
                try:
                    return infer(pd.Series([v])).iloc[0]
                except Exception as e:
                    return f"{type(e).__name__}: {e}"

            try:
                return infer(values)
            except Exception:
                return values.map(one)

        out = run(F.col("input"))
    return rows.withColumn("output", out).withColumn("state", F.lit(COMPLETE))


def work(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, infer: Callable[[pd.Series], pd.Series] | None = None, once: bool = True) -> StreamingQuery:
    """Answer requests as they arrive, each exactly once: every micro-batch is a folder named by its number, rewritten if retried."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        answer(batch, infer).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
