"""Files on the driver's machine: checks, a cache, and an interactive shell."""

from __future__ import annotations

import code
import hashlib
import logging
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import PathDoesNotExist, PathExists

logger = logging.getLogger("millrace")


def require_path(path: str) -> str:
    """The absolute path, if it is there."""
    if not Path(path).exists():
        raise PathDoesNotExist(path)
    return str(Path(path).absolute())


def require_no_path(path: str) -> str:
    """The absolute path, if nothing is there."""
    if Path(path).exists():
        raise PathExists(path)
    return str(Path(path).absolute())


def cached(path: str, folder: str | None = None) -> str:
    """A copy of a file in ``folder`` (or ``$MILLRACE_CACHE``), made anew when size or time differ; without a folder the file itself."""
    source = Path(require_path(path))
    folder = folder or os.environ.get("MILLRACE_CACHE")
    if not folder:
        return str(source)
    target = Path(folder, f"{hashlib.md5(str(source.parent).encode()).hexdigest()[:8]}-{source.name}")
    target.parent.mkdir(parents=True, exist_ok=True)
    a = source.stat()
    if not target.exists() or (b := target.stat()).st_size != a.st_size or int(b.st_mtime) != int(a.st_mtime):
        fresh = target.with_name(f"{target.name}.{os.getpid()}")
        shutil.copy2(source, fresh)
        fresh.replace(target)
    return str(target)


def distributed(spark: SparkSession, path: str) -> str:
    """Send a file to every executor, once, and return the name by which tasks find it: ``SparkFiles.get(name)``.

    The name tells folder, size and time of the file, so a changed file is another one, and one that was sent is not sent again.
    """
    source = Path(require_path(path))
    stat = source.stat()
    name = f"{hashlib.md5(str(source.parent).encode()).hexdigest()[:8]}-{stat.st_size}-{stat.st_mtime_ns}-{source.name}"
    if not any(p.rstrip("/").endswith(f"/{name}") for p in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp(prefix="millrace-")  # the driver serves it from here; executors fetch their own copy
        shutil.copy2(source, Path(folder, name))
        spark.sparkContext.addFile(str(Path(folder, name)))
    return name


def log_to(level: str = "INFO", path: str | None = None) -> None:
    """Log to the terminal, and to a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=level, format="%(asctime)s [%(levelname).1s] %(message)s", handlers=handlers, force=True)


def load(spark: SparkSession, path: str, eager: bool = False):
    """A dataset to look at: a DataFrame, or all of it in pandas."""
    df = spark.read.parquet(path)
    return df.toPandas() if eager else df


def shell(spark: SparkSession, path: str, eager: bool = False) -> None:
    """An interactive session with ``dataset`` loaded."""
    code.interact(banner=f"dataset: {path}", local={"dataset": load(spark, path, eager), "spark": spark})
