"""Index-first WARC archives.

Archives are files of one gzip member per record. While they are written, every
record's archive, offset, length, URL and digest go to an index table; reading starts from
the index: the selected entries are sorted by place, neighbouring byte ranges are
coalesced into one read, and each record is cut out of it.

Archives are named by the attempt that writes them and the index is committed by Spark's
own protocol, so a task that runs twice leaves an archive that no entry names. File systems are
those of ``pyarrow.fs``: local and mounted paths, hdfs, s3, gs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small, stage

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
#: An archive is closed once it is this long.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than this are read at once, up to the second figure.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Digests of payloads that occur again which may be broadcast, so that no payload is shuffled.
MOST_AGAIN = 500_000


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, record_type, refers_to`` for every page.

    Of pages with equal payloads of at least ``min_bytes``, that with the largest page_id is
    the response and the others revisit it. Only digests that occur more than once are
    joined back, and the join's skewed keys can be split: a digest has one row on that side.
    """
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("payload_digest", F.sha1("payload"))
    again = stage(
        rows.filter(F.length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first_id"),
        "warc-again",
    )
    revisit = F.coalesce(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.lit(False))
    return rows.join(small(again, MOST_AGAIN), "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    url = "".join(c for c in url if c not in "\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, page ids and the block's parts of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri", ""),
        "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"),
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "payload_bytes": declared,
        "payload": None if fields["warc-type"] == "revisit" else payload,
    }


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write the rows of :func:`with_revisits` as archives below ``folder``; return the index, which is a table there too."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        fs.create_dir(f"{base}/archives", recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for columns in zip(*batch.columns, strict=True):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in columns)
                if out is None:
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, payload, digest, kind, refers_to)) + packer.flush()
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, kind))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_NAMES).astype({"page_id": "Int64"}), schema=_SCHEMA, preserve_index=False)
        if out is not None:
            out.close()

    records.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return records.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64()}[x.split()[1]]) for x in INDEX.split(", ")])


def read_records(index: DataFrame, folder: str, payloads: bool = False, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that ``index`` names, read back by coalesced ranges and checked against their digest.

    Returns ``page_id, url, record_type, refers_to, payload_digest, payload_bytes``, and ``payload`` on request.
    Raises where a record is not what the index says.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_digest": "string", "payload_bytes": "long", "payload": "binary"}
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kinds[n]]) for n in names])

    def runs(pdf: pd.DataFrame) -> Iterator[list]:
        run: list = []
        for row in pdf.itertuples(index=False):
            end = run[-1].offset + run[-1].length if run else 0
            if run and (row.archive != run[0].archive or row.offset > end + gap or row.offset < end or row.offset + row.length - run[0].offset > most):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        name, file = None, None
        for batch in batches:
            out: list[dict] = []
            for run in runs(batch.to_pandas()):
                if run[0].archive != name:
                    if file is not None:
                        file.close()
                    name, file = run[0].archive, fs.open_input_file(f"{base}/{run[0].archive}")
                first = run[0].offset
                blob = file.read_at(run[-1].offset + run[-1].length - first, first)
                for row in run:
                    got = parse_record(zlib.decompress(blob[row.offset - first : row.offset - first + row.length], 31))
                    body = got["payload"]
                    if got["payload_digest"] != row.payload_digest or (body is not None and (hashlib.sha1(body).hexdigest() != row.payload_digest or len(body) != got["payload_bytes"])):
                        raise ValueError(f"{row.archive} at {row.offset}: not the record of the index")
                    out.append({n: got[n] for n in names})
                if payloads:  # no more of them at once than a range holds
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file is not None:
            file.close()

    places = index.select("archive", "offset", "length", "payload_digest")
    ordered = places.repartitionByRange(F.col("archive"), F.col("offset")).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names))


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Archive all ``pages`` (``page_id, url, html``) and read every record back.

    Returns the columns of :func:`read_records`. Null html is an empty payload, whole payloads are written however long (each is
    one gzip member, held by one task at a time), and null URLs are empty; a null page_id stays null. Rows that repeat both payload and the largest
    page_id are all responses. An empty table gives an empty result; extra columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    index = write_archives(with_revisits(pages, min_bytes), folder)
    return read_records(index, folder)
