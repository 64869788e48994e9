"""Queries of sources, archives and native tools: files made of the tables, written to the shared folder, and read back."""

from __future__ import annotations

import io
import json
import tarfile
import tempfile
import zipfile

from pyspark import SparkFiles
from pyspark.sql import functions as F

from ..operators import frame, native, report, service
from ..operators.report import Counts
from ..sources import archives, local, parquet, striped
from ..sources import text as files
from ..sources.shared import new_path, staged
from . import fixtures as fx
from . import pipelines
from .fixtures import table
from .runner import modify


def json_samples(spark, sf):
    """Coding samples from lines of JSON."""
    path = new_path(spark, "samples")
    part = table(spark, sf, "part")
    files.write_json_lines(
        part.select(F.col("p_partkey").cast("string").alias("task_id"), F.col("p_name").alias("prompt"), F.concat(F.col("p_brand"), F.lit("\n{")).alias("declaration"), F.concat("p_type", F.lit('"}')).alias("canonical_solution")),
        path,
    )
    return files.samples(spark, path)


def json_list(spark, sf):
    """One list of all rows in order, and its items."""
    path = new_path(spark, "list")
    files.write_json_list(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, "s_name")
    items = files.merge_json(files.json_values(spark, path))
    return items.select("pos", F.variant_get("value", "$.s_suppkey", "bigint").alias("s_suppkey"), F.variant_get("value", "$.s_name", "string").alias("s_name"))


def csv_files(spark, sf):
    path = new_path(spark, "csv")
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("version")), path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_orderpriority string, version string")


def vulnerability_order(spark, sf):
    """Records of several files, in the order of files, then keys, then items."""
    paths = []
    for k in (1, 0):
        paths.append(new_path(spark, f"map-{k}"))
        record = F.struct(F.col("n_name").alias("repo"), F.concat(F.lit("CVE-"), "n_nationkey").alias("cve_name"), F.array("n_name", F.lit(" Other ")).alias("function_names"), F.col("n_regionkey").cast("string").alias("binary_version"))
        entries = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", record.alias("r")))), lambda x: F.struct(x["n_nationkey"].cast("string"), F.array(x["r"])))
        rows = table(spark, sf, "nation").filter(F.col("n_nationkey") % 2 == k)  # the nations are 25 rows
        rows.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(paths[-1])
    found = files.vulnerabilities(spark, *paths)
    return frame.number(found, "place", "ord").select("place", "project", "fname", "cve_name", "version")


def archive_members(spark, sf):
    """Members of a tar and a zip file with a text for each region."""
    rows = [(r["r_regionkey"], r["r_name"].encode()) for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]  # five regions
    tar, zipped = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t, zipfile.ZipFile(zipped, "w") as z:
        for key, name in rows:
            info = tarfile.TarInfo(f"regions/{key}.txt")
            info.size = len(name)
            t.addfile(info, io.BytesIO(name))
            z.writestr(f"regions/{key}.txt", name)
    found = None
    for kind, data in (("tar", tar), ("zip", zipped)):
        some = archives.members(spark.createDataFrame([(f"all.{kind}", bytearray(data.getvalue()))], "path string, content binary"), kind)
        found = some if found is None else found.union(some)
    return found.select("archive", "name", "kind", F.col("data").cast("string").alias("text"))


def _program(binary: bytes) -> native.Program:
    """A program as a disassembler might show one: the bytes name a supplier and a nation."""
    supplier, nation = (int(x) for x in binary.decode().split(","))
    t = native.Token
    first = (t("address separator"), t("instruction", "mov "), t("register", "eax"), t("operand separator", ", "), t("integer", "0x0", supplier))
    second = (
        t("address separator"), t("instruction", "mov"), t("text", " "), t("keyword", "qword "), t("begin memory operand"), t("brace", "["), t("register", "fs"), t("operation", ":"),
        t("integer", "", nation), t("brace", "]"), t("annotation", "{"), t("data symbol", "x", 1), t("annotation", "}"), t("address separator"), t("instruction", "call"), t("operation", "$+5"),
    )
    blocks = (native.Block(32, binary[-1:], second), native.Block(16, binary[:1], first, valid=nation != 1))
    own = native.Function(f"f{supplier}", blocks, thunk=nation == 0)
    return native.Program("x86_64", (own, native.Function("puts", blocks, symbol="external")))


def disassemble_program(spark, sf):
    """Blocks by address, tokens by the grammar; thunks, foreign functions and those with invalid instructions left out."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat_ws(",", "s_suppkey", "s_nationkey").cast("binary").alias("binary"))
    found = native.disassemble(rows, native.program_disassembler(_program))
    return found.select("id", "name", "disassembly", F.hex("binary").alias("code"))


def project_folders(spark, sf):
    """A folder for each project that has rows, and what is in them."""
    path = new_path(spark, "projects")
    pipelines.write_by_project(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("project"), "o_orderkey"), path)
    return parquet.with_file(spark.read.parquet(path)).groupBy("project").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def completion_newest(spark, sf):
    return service.newest(fx.completions(spark, sf), fx.users(spark, sf), 8).select("id", "timestamp", "completed", "username")


def _ordered_files(spark, sf):
    """Orders in files by ranges of their keys: the order of files by name, and of rows in them, is that of keys."""
    path = new_path(spark, "files")
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").repartitionByRange(11, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return path


def striped_reader(spark, sf):
    """Rows of many files by four readers; each has the reader, file and place that Spark's own scan of the files gives it."""
    path = _ordered_files(spark, sf)
    names = sorted(f.rpartition("/")[2] for f in parquet.files(spark, path))
    turns = spark.createDataFrame([(name, k % 4) for k, name in enumerate(names)], "file string, turn int")
    own = spark.read.parquet(path).select("o_orderkey", F.col("_metadata.file_name").alias("own_file"), F.col("_metadata.row_index").alias("own_place"))
    rows = striped.read_striped(spark, path, readers=4, place=True).join(F.broadcast(turns), "file").join(own, "o_orderkey")
    right = (F.col("file") == F.col("own_file")) & (F.col("place") == F.col("own_place")) & (F.col("reader") == F.col("turn"))
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice", right.alias("in_turn"))


def file_numbers(spark, sf):
    """Numbers by files and places in them, with no shuffle of rows."""
    return parquet.number_in_files(spark, _ordered_files(spark, sf)).select("o_orderkey", "row")


def chunk_map(spark, sf):
    """A column renamed and rows dropped file by file: every row stays in the file of its rank."""
    path, out = _ordered_files(spark, sf), new_path(spark, "mapped")
    names = parquet.map_chunks(spark, path, out, [lambda df: df.filter("o_orderkey % 3 <> 0"), frame.rename({"o_orderpriority": "priority"}), frame.keep("o_orderkey", "priority")])
    ranks = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(names)], "before string, after string, rank int")
    at = lambda p, name: spark.read.parquet(p).select(F.col("o_orderkey").alias(f"{name}_key"), F.col("_metadata.file_name").alias(name))
    rows = spark.read.parquet(out).select("o_orderkey", "priority", F.col("_metadata.file_name").alias("after")).join(F.broadcast(ranks), "after")
    rows = rows.join(at(path, "own"), F.col("o_orderkey") == F.col("own_key"))
    return rows.select("o_orderkey", "priority", (F.col("own") == F.col("before")).alias("same_chunk"))


def sized_files(spark, sf):
    """Whole texts in files of at most 256 KB: no file is larger, and none is lost."""
    path = new_path(spark, "sized-files")
    parquet.write(table(spark, sf, "documents").select("doc_id", "text"), path, size="256KiB")
    return spark.read.parquet(path).select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("_metadata.file_size") <= 256 * 1024).alias("within"))


def stage_counts(spark, sf):
    """Rows of each operation of a run from dataset to dataset, counted by its own job."""
    counts, out = Counts(), new_path(spark, "counted")
    modify(spark, f"{sf}/documents.parquet", out, [frame.keep("doc_id", "text", "source"), frame.hash_column("text", "hash"), frame.deduplicate("hash", "source"), frame.deduplicate("hash"), frame.drop("hash")], counts=counts)
    return counts.table(spark).select("stage", "name", "rows")


def dropped_records(spark, sf):
    """Records that a parser refuses, with the reason, joined to the rows they came from."""

    def parse(row):
        k = json.loads(row["props"])["k"]
        if k < 20:
            raise ValueError(f"k is {k}")
        yield {"k": k} if k % 10 else {"error": "round number"}

    rows = table(spark, sf, "events").select("event_id", "props")
    tried = staged(report.attempt(rows, parse, "k long"), "attempts")
    good, bad = report.divided(tried)
    users = table(spark, sf, "events").select("event_id", "user_id")
    return bad.select("event_id", "error", F.lit(None).cast("long").alias("k")).union(good.select("event_id", F.lit(None).cast("string"), "k")).join(users, "event_id")


def distributed_file(spark, sf):
    """Names that tasks look up in a file sent to their executor."""
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump({str(r["n_nationkey"]): r["n_name"] for r in nations}, f)
        f.flush()
        name = local.distributed(spark, f.name)

    def look_up(batches):
        with open(SparkFiles.get(name)) as f:
            names = json.load(f)
        for batch in batches:
            yield batch.assign(nation=batch["s_nationkey"].astype(str).map(names))

    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(look_up, "s_suppkey long, s_nationkey long, nation string").drop("s_nationkey")


def footer_count(spark, sf):
    return parquet.footer_count(spark, f"{sf}/lineitem.parquet")


QUERIES = {
    "striped_reader": (striped_reader, "SELECT o_orderkey, o_orderpriority, o_totalprice, true AS in_turn FROM orders"),
    "file_numbers": (file_numbers, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders"),
    "chunk_map": (chunk_map, "SELECT o_orderkey, o_orderpriority AS priority, true AS same_chunk FROM orders WHERE o_orderkey % 3 <> 0"),
    "sized_files": (sized_files, "SELECT doc_id, length(text) AS n_chars, true AS within FROM documents"),
    "stage_counts": (
        stage_counts,
        """SELECT CAST(stage AS INTEGER) AS stage, name, rows FROM (
            SELECT 0 AS stage, 'input' AS name, count(*) AS rows FROM documents UNION ALL SELECT 1, 'keep', count(*) FROM documents UNION ALL SELECT 2, 'hash_column', count(*) FROM documents
            UNION ALL SELECT 3, 'deduplicate', count(*) FROM (SELECT DISTINCT text, source FROM documents) UNION ALL SELECT 4, 'deduplicate', count(*) FROM (SELECT DISTINCT text FROM documents)
            UNION ALL SELECT 5, 'drop', count(*) FROM (SELECT DISTINCT text FROM documents))""",
    ),
    "dropped_records": (
        dropped_records,
        """SELECT event_id, CASE WHEN k < 20 THEN 'ValueError: k is ' || k WHEN k % 10 = 0 THEN 'round number' END AS error, CASE WHEN k >= 20 AND k % 10 <> 0 THEN k END AS k, user_id
            FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
    ),
    "distributed_file": (distributed_file, "SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "footer_count": (footer_count, "SELECT count(*) AS rows FROM lineitem"),
    "json_samples": (json_samples, "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand || chr(10) || '{' || p_type || '\"}' AS source, p_name AS summary FROM part"),
    "json_list": (json_list, "SELECT CAST(row_number() OVER (ORDER BY s_name) - 1 AS INTEGER) AS pos, s_suppkey, s_name FROM supplier"),
    "csv_files": (csv_files, "SELECT o_orderkey, o_orderpriority, CAST(o_orderkey AS VARCHAR) AS version FROM orders"),
    "vulnerability_order": (
        vulnerability_order,
        """SELECT row_number() OVER (ORDER BY n_nationkey % 2 DESC, n_nationkey, i) - 1 AS place, n_name AS project,
            lower(trim(names[i])) AS fname, 'CVE-' || n_nationkey AS cve_name, CAST(n_regionkey AS VARCHAR) AS version
            FROM (SELECT *, [n_name, ' Other '] AS names, unnest([1, 2]) AS i FROM nation)""",
    ),
    "archive_members": (
        archive_members,
        """SELECT 'all.' || format AS archive, 'regions/' || r_regionkey || '.txt' AS name, 'file' AS kind, r_name AS text
            FROM region, (VALUES ('tar'), ('zip')) k(format)""",
    ),
    "disassemble_program": (
        disassemble_program,
        """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'f' || s_suppkey AS name,
            'mov eax ' || s_suppkey || ' [NEXT] mov qword [ fs + ' || s_nationkey || ' ] [NEXT] call rel 5' AS disassembly,
            hex(encode(substr(CAST(s_suppkey AS VARCHAR), 1, 1) || right(CAST(s_nationkey AS VARCHAR), 1))) AS code
            FROM supplier WHERE s_nationkey NOT IN (0, 1)""",
    ),
    "project_folders": (project_folders, "SELECT o_orderpriority AS project, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"),
    "completion_newest": (
        completion_newest,
        f"""SELECT c.id, strftime(c.timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, c.state = 2 AS completed, u.username
            FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id WHERE c.user_id = 8 ORDER BY c.timestamp DESC, c.id DESC LIMIT 100""",
    ),
}
