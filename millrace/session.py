"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

import io
import os
import shlex
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import EnvironmentError  # noqa: A004
from .functions.text import parse_size

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def cluster(kind: str = "local", parallelism: int = 1, memory: str = "16g", master: str | None = None, **settings: str) -> SparkSession:
    """A session on this machine (``local``), or on the cluster at ``master`` (``spark``, ``yarn``, ``k8s``), or on that of a job by :func:`slurm_job` (``slurm``)."""
    builder = SparkSession.builder
    if kind == "local":
        builder = builder.master(f"local[{parallelism}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(max(8, parallelism)))
    elif kind in ("spark", "yarn", "k8s", "slurm"):
        if kind == "slurm":
            master = master or os.environ.get("SPARK_MASTER")
            if not master:
                raise EnvironmentError("SPARK_MASTER is not set: start this in a job made by slurm_job")
        if kind != "yarn" and not master:
            raise ValueError(f"a {kind} cluster needs its master's address")
        builder = builder.master(master or "yarn").config("spark.executor.memory", memory).config("spark.executor.instances", str(parallelism))
    else:
        raise ValueError(f"unknown cluster type {kind!r}")
    spark = builder.config(map={**SETTINGS, **settings}).getOrCreate()
    if kind != "local":
        ship(spark)
    return spark


def slurm_job(command: list[str], parallelism: int = 1, cores: int = 1, memory: str = "16GB", partition: str | None = None, logs: str = ".", port: int = 7077) -> str:
    """A batch script for SLURM: Spark's own cluster manager in the allocation, ``command`` on it, and its end.

    There is a worker for each of ``parallelism`` tasks, with ``cores`` and ``memory``; ``command`` finds the master in ``SPARK_MASTER``, as
    ``cluster("slurm")`` does. A worker that is lost is one less: its tasks go to the others.
    """
    mb = parse_size(memory) // 10**6
    options = [f"--ntasks={parallelism}", f"--cpus-per-task={cores}", f"--mem-per-cpu={-(-mb // cores)}M", f"--output={logs}/%x-%j.out", *([f"--partition={partition}"] if partition else [])]
    start = '"$SPARK_HOME/bin/spark-class" org.apache.spark.deploy'
    return "\n".join(
        [
            "#!/bin/bash",
            *[f"#SBATCH {x}" for x in options],
            'export SPARK_HOME="${SPARK_HOME:-$(python -c \'import pyspark; print(pyspark.__path__[0])\')}"',
            f'export SPARK_MASTER="spark://$(hostname):{port}"',
            f'{start}.master.Master --host "$(hostname)" --port {port} --webui-port 0 &',
            "MASTER_PID=$!",
            f'srun --overlap {start}.worker.Worker --cores {cores} --memory {mb}M --webui-port 0 "$SPARK_MASTER" &',
            "WORKERS_PID=$!",
            shlex.join(command),
            "STATUS=$?",
            'kill "$WORKERS_PID" "$MASTER_PID"',
            'exit "$STATUS"',
            "",
        ]
    )


def archive() -> bytes:
    """This package, and the pipeline beside it if it is there, as a zip that Python imports from."""
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted([*root.rglob("*.py"), *root.parent.glob("corpus_pipeline.py")]):
            z.write(path, path.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Give the package to all executors, present and future ones: what runs there imports it by name.

    It is not needed where the package is installed on every machine.
    """
    path = Path(tempfile.mkdtemp(prefix="millrace-"), "millrace-package.zip")  # served by the driver from here
    path.write_bytes(archive())
    spark.sparkContext.addPyFile(str(path))


def flush(spark: SparkSession) -> None:
    """Retire a session and its executors."""
    spark.stop()
