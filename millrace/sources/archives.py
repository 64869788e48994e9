"""Archives: one row for each member, read from ``binaryFile`` scans on the executors.

A member is ``archive, name, kind, mode, mtime, data``; ``kind`` is ``file``, ``directory`` or ``link`` (``data`` is then the
target). Members that would leave the folder they are unpacked to raise, as do files of another type.
"""

from __future__ import annotations

import io
import sqlite3
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFileType, PathExists

MEMBERS = "archive string, name string, kind string, mode long, mtime long, data binary"
Member = tuple[str, str, int, int, bytes | None]


def _safe(name: str) -> str:
    p = PurePosixPath(name)
    if p.is_absolute() or ".." in p.parts:
        raise InvalidFileType(f"member {name!r} leaves the archive's folder")
    return name


def tar_members(data: bytes) -> Iterator[Member]:
    """Members of a tar file, whatever its compression."""
    try:
        archive = tarfile.open(fileobj=io.BytesIO(data), mode="r")
    except tarfile.TarError as e:
        raise InvalidFileType(f"not a tar file: {e}") from e
    with archive:
        for m in archive:
            name = _safe(m.name)
            if m.isdir():
                yield name, "directory", m.mode, int(m.mtime), None
            elif m.issym() or m.islnk():
                yield name, "link", m.mode, int(m.mtime), _safe(m.linkname).encode()
            elif m.isfile():
                yield name, "file", m.mode, int(m.mtime), archive.extractfile(m).read()


def zip_members(data: bytes) -> Iterator[Member]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise InvalidFileType(f"not a zip file: {e}") from e
    with archive:
        for m in archive.infolist():
            name = _safe(m.filename)
            at = int(pd.Timestamp(*m.date_time).timestamp())
            yield name.rstrip("/"), "directory" if m.is_dir() else "file", m.external_attr >> 16, at, None if m.is_dir() else archive.read(m)


def inflate(data: bytes, size: int) -> bytes:
    """Stored bytes as they are, and shorter ones inflated."""
    return zlib.decompress(data) if len(data) < size else data


def sqlar_members(data: bytes) -> Iterator[Member]:
    """Members of an SQLite archive. No data: a directory; a size of -1: a link."""
    with tempfile.NamedTemporaryFile(suffix=".sqlar") as f:
        f.write(data)
        f.flush()
        try:
            with sqlite3.connect(f.name) as db:
                rows = db.execute("SELECT name, mode, mtime, sz, data FROM sqlar").fetchall()
        except sqlite3.DatabaseError as e:
            raise InvalidFileType(f"not an SQLite archive: {e}") from e
    for name, mode, mtime, size, blob in rows:
        if blob is None:
            yield _safe(name), "directory", mode, mtime, None
        elif size == -1:
            yield _safe(name), "link", mode, mtime, blob if isinstance(blob, bytes) else str(blob).encode()
        else:
            yield _safe(name), "file", mode, mtime, inflate(blob, size)


READERS: dict[str, Callable[[bytes], Iterator[Member]]] = {"tar": tar_members, "zip": zip_members, "sqlar": sqlar_members}


def members(archives: DataFrame, kind: str) -> DataFrame:
    """Members of every row of a ``binaryFile`` scan (``path, content``)."""
    read = READERS[kind]

    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *m) for m in read(bytes(content))]
                yield pd.DataFrame(rows, columns=["archive", "name", "kind", "mode", "mtime", "data"]).astype({"mode": "int64", "mtime": "int64"})

    return archives.select("path", "content").mapInPandas(open_all, MEMBERS)


def scan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return members(spark.read.format("binaryFile").load(path), kind)


def challenge_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of a challenge's data, then of its solutions."""
    return scan(spark, f"{path}/raw_data.sqlar", "sqlar").union(scan(spark, f"{path}/solutions.sqlar", "sqlar"))


def challenges(spark: SparkSession, path: str) -> DataFrame:
    """``challenge, solutions, attempts`` of the folders directly below ``path``, but for ``static``.

    ``solutions`` tells whether a folder holds ``solutions.sqlar``, ``attempts`` whether anything lies in its
    ``raw_data/attempts``; those to skip and report are the rows where one is false. Only the listing is read, never a
    file's content, and a folder without any file is not listed.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(root).getPath().toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    parts = F.split(below, "/")
    inner = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    rows = files.select(F.element_at(parts, 1).alias("challenge"), F.size(parts).alias("depth"), inner.alias("inner"))
    return rows.filter("depth > 1 and challenge <> 'static'").groupBy("challenge").agg(
        F.bool_or(F.col("inner") == "solutions.sqlar").alias("solutions"), F.bool_or(F.startswith("inner", F.lit("raw_data/attempts/"))).alias("attempts")
    )


def folder_of(path: str) -> str:
    """Where a zip file is unpacked: its path without the extension."""
    return str(Path(path).with_suffix(""))


def extract(archive: str, output: str, kind: str) -> str:
    """Unpack one archive of the driver's file system into a folder; skipped if the folder is there."""
    target = Path(output)
    if target.exists():
        if not target.is_dir():
            raise PathExists(output)
        return output
    found = list(READERS[kind](Path(archive).read_bytes()))
    for name, what, _, _, data in found:
        at = target / name
        at.parent.mkdir(parents=True, exist_ok=True)
        if what == "directory":
            at.mkdir(parents=True, exist_ok=True)
        elif what == "link":
            at.symlink_to(data.decode())
        else:
            at.write_bytes(data)
    target.mkdir(parents=True, exist_ok=True)
    return output


def archive_names(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("archive", r"([^/]*)$", 1).alias("archive"), "name", "kind")
