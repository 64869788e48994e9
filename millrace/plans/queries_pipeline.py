"""Queries of the dataset pipeline: projections, deduplication, text, links, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import frame, link, native, split
from ..sources import parquet
from ..sources.text import merge_json
from . import fixtures as fx
from .fixtures import table

_WORDS = r"regexp_extract_all(text, '[^\s]+')"


def hash_dedup_drop(spark, sf):
    return fx.sources(spark, sf).drop("id").transform(frame.hash_dedup_drop("source", order="doc_id"))


def keep_columns(spark, sf):
    return table(spark, sf, "orders").transform(frame.keep("o_custkey", "o_orderkey"))


def drop_columns(spark, sf):
    return table(spark, sf, "orders").transform(frame.drop("o_orderdate", "o_orderpriority"))


def rename_columns(spark, sf):
    """Names are swapped, which renaming one after the other could not do."""
    return table(spark, sf, "nation").transform(frame.rename({"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}))


def keep_then_rename(spark, sf):
    return table(spark, sf, "documents").transform(frame.compose(frame.keep("doc_id", "lang"), frame.rename({"lang": "language"})))


def hash_column(spark, sf):
    return table(spark, sf, "documents").transform(frame.hash_column("text", "hash")).select("doc_id", "hash")


def dedup_single(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type").transform(frame.deduplicate("user_id", order="event_id"))


def dedup_multi(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("place", F.struct("l_partkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place").transform(frame.deduplicate("l_orderkey", "l_linenumber", order="place")).drop("place")


def repartition_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").transform(frame.repartition(chunks=25))


def repartition_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").transform(frame.repartition(size="1MB"))


def path_hash_prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.cache_name(F.col("url")).alias("name"))


def path_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.dirname(u).alias("folder"), text.basename(u).alias("base"), text.join_path("cache", text.basename(u)).alias("joined"))


def timestamp_tag(spark, sf):
    return table(spark, sf, "events").select("event_id", text.timestamp_tag(F.col("ts")).alias("tag"), text.iso_utc(F.col("ts")).alias("iso"))


def enforce_extension(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.enforce_extension(F.col("url"), ".parquet").alias("path"))


def sanitize_text(spark, sf):
    raw = F.concat(F.lit("  [CLS]\t"), "text", F.lit(" [MASK] [mask] [NEXT"))
    return table(spark, sf, "documents").select("doc_id", text.sanitize(raw).alias("clean"))


def lines_to_next(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.lines_to_next(F.col("text")).alias("joined"))


def next_to_lines(spark, sf):
    return fx.traces(spark, sf).select("id", text.next_to_lines(F.col("disassembly")).alias("lines"))


def format_and_highlight(spark, sf):
    d = F.concat(F.col("disassembly"), F.lit(" [MASK] [PAD] [PAD]"))
    return fx.traces(spark, sf).select(
        "id", text.format_tokens(d).alias("markdown"), text.highlight(F.col("disassembly"), "opa").alias("marked"), text.strip_padding(d).alias("stripped")
    )


def lower_strip(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalized(F.concat(F.lit(" \t"), F.upper("p_name"), F.lit(" \n"))).alias("name"))


def search_text(spark, sf):
    return table(spark, sf, "documents").filter(text.searched(F.col("text"), " TION ")).select("doc_id")


def task_template(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.task_text(F.col("p_name"), F.col("p_type")).alias("task"), link.solution_name(F.col("p_brand"), F.col("p_size"), F.col("p_type")).alias("solution"))


def merge_json_values(spark, sf):
    """Objects, single values and lists in the order of files and places."""
    k = F.col("event_id") % 3
    value = F.when(k == 0, F.col("props")).when(k == 1, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(",7]")))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("file"), F.parse_json(value).alias("value"))
    return merge_json(rows).select("file", F.col("pos").cast("int").alias("pos"), F.coalesce(F.try_variant_get("value", "$.k", "bigint"), F.try_variant_get("value", "$", "bigint")).alias("number"))


def flatten_nested_json(spark, sf):
    rows = link.flatten_vulnerabilities(fx.vulnerability_records(spark, sf))
    return rows.select("project", "fname", "cve_name", "version", F.col("ord.ord").alias("ord"))


def wildcard_link(spark, sf):
    found = link.link_vulnerabilities(fx.functions(spark, sf), link.flatten_vulnerabilities(fx.vulnerability_records(spark, sf)))
    return found.select("id", "vulnerability")


def latest_attempt(spark, sf):
    return link.latest(fx.attempts(spark, sf), ["competitor"], "i").select("competitor", "i", "language")


def numbered_attempts(spark, sf):
    return link.all_attempts(fx.attempts(spark, sf), ["competitor"], "i").select("competitor", "i", F.col("attempt").cast("int").alias("attempt"))


def language_filter(spark, sf):
    return fx.attempts(spark, sf).filter(link.supported(F.col("language"))).select("competitor", "i", "language")


def all_tests_pass(spark, sf):
    verdict = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 1)
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.coalesce(verdict, F.lit(0))).alias("verdicts"))
    return rows.select("l_orderkey", link.all_pass(F.col("verdicts")).alias("passed"))


def with_solution(spark, sf):
    return link.present(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


def missing_solution(spark, sf):
    return link.missing(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


def attempt_solution_join(spark, sf):
    attempts = fx.attempts(spark, sf).withColumn("solution", link.solution_name(F.col("competitor").cast("string"), F.col("i"), F.col("language")))
    solutions = table(spark, sf, "orders").select(
        link.solution_name((F.col("o_orderkey") % 500).cast("string"), F.col("o_custkey") % 5, F.lit("CPP")).alias("solution"), F.lit("int main() {}").alias("source")
    ).distinct()
    return link.with_solutions(attempts, solutions).select("competitor", "i", "solution", "source")


def task_lookup(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("task_id"))
    return link.with_tasks(rows, table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_id"), F.col("n_name").alias("task"))).select("c_custkey", "task_id", "task")


def success_ratio(spark, sf):
    return native.success_ratio(table(spark, sf, "documents"), F.length("text") > 500)


def size_arch_filter(spark, sf):
    files = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("project"), F.octet_length("text").alias("length"),
        F.concat(F.lit("bin-"), F.when(F.col("lang") == "en", "x86_64").when(F.col("lang") == "de", "i686").otherwise("arm"), F.lit("-O2")).alias("filename"),
    )
    return link.binary_files(files, 5_000, exclude=("src0", "src3")).select("doc_id", "project", F.col("length").cast("long").alias("length"), "filename")


def exclusion_filter(spark, sf):
    return table(spark, sf, "documents").filter(~F.col("source").isin(*("src1", "src2"))).select("doc_id", "source")


def sequential_id(spark, sf):
    return link.sequential_id(table(spark, sf, "supplier").select("s_name"), "s_name")


def split_train_valid(spark, sf):
    return fx.sources(spark, sf).select("id", split.split_name(F.col("id"), {"train": 90, "valid": 10}).alias("part"))


def split_three_way(spark, sf):
    parts = split.hash_split(fx.sources(spark, sf).select("id"), {"train": 80, "valid": 10, "test": 10})
    out = None
    for name, part in parts.items():
        named = part.withColumn("part", F.lit(name))
        out = named if out is None else out.union(named)
    return out.groupBy("part").agg(F.count("*").alias("n"))


def random_split(spark, sf):
    return split.random_split(fx.sources(spark, sf).select("id"), {"train": 90, "valid": 10})["train"]


def reader_striping(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return split.stripe(rows, "source", 1, 3)


def dataset_len(spark, sf):
    return parquet.row_count(table(spark, sf, "lineitem"))


def multi_path_scan(spark, sf):
    """Two datasets of one schema as one."""
    rows = parquet.read(spark, [f"{sf}/region.parquet", f"{sf}/region.parquet"])
    return rows.groupBy("r_regionkey").agg(F.count("*").alias("n"))


def generate_numbers(spark, sf):
    return split.generate_numbers(spark, 64).withColumn("reciprocal", split.reciprocal(F.col("number")))


def reciprocal(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")).withColumn("reciprocal", split.reciprocal(F.col("l_quantity")))


def _bucket(seed: int, key: str, kind: str = "") -> str:
    return f"(CAST('0x' || substr(sha256(concat_ws(':', '{seed}', {key}{kind})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_DOC_BUCKET = _bucket(42, "CAST(doc_id AS VARCHAR)")
_FOLDER = r"CASE WHEN regexp_matches(regexp_extract(url, '^(.*/)[^/]*$', 1), '^/+$') THEN regexp_extract(url, '^(.*/)[^/]*$', 1) ELSE regexp_replace(regexp_extract(url, '^(.*/)[^/]*$', 1), '/+$', '') END"
_BASE = "regexp_extract(url, '([^/]*)$', 1)"

QUERIES = {
    "hash_dedup_drop": (hash_dedup_drop, "SELECT min(doc_id) AS doc_id, text AS source FROM documents GROUP BY text"),
    "keep_columns": (keep_columns, "SELECT o_custkey, o_orderkey FROM orders"),
    "drop_columns": (drop_columns, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "rename_columns": (rename_columns, "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation"),
    "keep_then_rename": (keep_then_rename, "SELECT doc_id, lang AS language FROM documents"),
    "hash_column": (hash_column, "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "dedup_single": (dedup_single, "SELECT min(event_id) AS event_id, user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "dedup_multi": (
        dedup_multi,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem "
        "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1",
    ),
    "repartition_chunks": (repartition_chunks, "SELECT doc_id, lang FROM documents"),
    "repartition_size": (repartition_size, "SELECT doc_id, text FROM documents"),
    "path_hash_prefix": (path_hash_prefix, f"SELECT page_id, substr(md5({_FOLDER}), 1, 8) || '-' || {_BASE} AS name FROM pages"),
    "path_parts": (path_parts, f"SELECT page_id, {_FOLDER} AS folder, {_BASE} AS base, 'cache/' || {_BASE} AS joined FROM pages"),
    "timestamp_tag": (
        timestamp_tag,
        "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS tag, strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
        "CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS iso FROM events",
    ),
    "enforce_extension": (
        enforce_extension,
        r"SELECT page_id, substr(url, 1, length(url) - length(regexp_extract(url, '[^/.][^/]*?(\.[^/.]*)$', 1))) || '.parquet' AS path FROM pages",
    ),
    "sanitize_text": (
        sanitize_text,
        r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(flat, '(\[[A-Z]+\]|[^\[]+|\[)', 1),
            lambda p: CASE WHEN regexp_full_match(p, '\[[A-Z]+\]') THEN p ELSE lower(p) END), '') AS clean
            FROM (SELECT doc_id, regexp_replace(regexp_replace('  [CLS]' || chr(9) || text || ' [MASK] [mask] [NEXT', '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS flat FROM documents)""",
    ),
    "lines_to_next": (
        lines_to_next,
        r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' [NEXT] ') AS joined FROM documents",
    ),
    "next_to_lines": (next_to_lines, rf"SELECT id, regexp_replace(disassembly, '\s*\[NEXT\]\s*', chr(10), 'g') AS lines FROM ({fx.TRACES})"),
    "format_and_highlight": (
        format_and_highlight,
        rf"""SELECT id, replace(replace(disassembly || ' [MASK] [PAD] [PAD]', '[NEXT] ', '[NEXT]' || chr(10)), '[MASK]', '**[MASK]**') AS markdown,
            regexp_replace(disassembly, '(opa)', '<mark>\1</mark>', 'gi') AS marked,
            regexp_replace(replace(disassembly || ' [MASK] [PAD] [PAD]', '[PAD]', ''), '^\s+|\s+$', '', 'g') AS stripped FROM ({fx.TRACES})""",
    ),
    "lower_strip": (lower_strip, "SELECT p_partkey, lower(p_name) AS name FROM part"),
    "search_text": (search_text, "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')"),
    "task_template": (
        task_template,
        "SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || p_type AS task, concat_ws('.', p_brand, CAST(p_size AS VARCHAR), lower(p_type)) AS solution FROM part",
    ),
    "merge_json_values": (
        merge_json_values,
        """SELECT event_id AS file, 0 AS pos, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id END AS number FROM events
           UNION ALL SELECT event_id, 1, 7::BIGINT FROM events WHERE event_id % 3 = 2""",
    ),
    "flatten_nested_json": (flatten_nested_json, f"SELECT project, fname, cve_name, version, ord FROM ({fx.VULNERABILITIES})"),
    "wildcard_link": (
        wildcard_link,
        f"""WITH f AS ({fx.FUNCTIONS}), c AS ({fx.VULNERABILITIES}),
            w AS (SELECT DISTINCT project, lower(trim(name)) AS fname, version FROM f),
            met AS (SELECT w.project, w.fname, w.version, c.cve_name, min((c.ord, c.i, c.j)) AS o FROM w JOIN c ON w.project = c.project AND w.fname = c.fname AND (w.version = c.version OR c.version = '-') GROUP BY ALL),
            names AS (SELECT project, fname, version, string_agg(cve_name, '-' ORDER BY o) AS v FROM met GROUP BY ALL)
            SELECT f.id, coalesce(n.v, '') AS vulnerability FROM f LEFT JOIN names n ON f.project = n.project AND lower(trim(f.name)) = n.fname AND f.version = n.version""",
    ),
    "latest_attempt": (latest_attempt, f"SELECT competitor, i, language FROM ({fx.ATTEMPTS}) QUALIFY row_number() OVER (PARTITION BY competitor ORDER BY i DESC) = 1"),
    "numbered_attempts": (numbered_attempts, f"SELECT competitor, i, CAST(row_number() OVER (PARTITION BY competitor ORDER BY i) - 1 AS INTEGER) AS attempt FROM ({fx.ATTEMPTS})"),
    "language_filter": (language_filter, f"SELECT competitor, i, language FROM ({fx.ATTEMPTS}) WHERE language IN ('C', 'CPP')"),
    "all_tests_pass": (all_tests_pass, "SELECT l_orderkey, bool_and(l_returnflag IN ('N', 'A')) AS passed FROM lineitem GROUP BY l_orderkey"),
    "with_solution": (with_solution, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "missing_solution": (missing_solution, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "attempt_solution_join": (
        attempt_solution_join,
        f"""WITH a AS (SELECT competitor, i, concat_ws('.', competitor, i, lower(language)) AS solution FROM ({fx.ATTEMPTS})),
            s AS (SELECT DISTINCT concat_ws('.', o_orderkey % 500, o_custkey % 5, 'cpp') AS solution, 'int main() {{}}' AS source FROM orders)
            SELECT competitor, i, a.solution, source FROM a JOIN s ON a.solution = s.solution""",
    ),
    "task_lookup": (task_lookup, "SELECT c_custkey, c_nationkey AS task_id, n_name AS task FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "success_ratio": (success_ratio, "SELECT count(*) FILTER (length(text) > 500) AS succeeded, count(*) AS total, count(*) FILTER (length(text) > 500) / count(*) AS ratio FROM documents"),
    "size_arch_filter": (
        size_arch_filter,
        """SELECT doc_id, source AS project, CAST(strlen(text) AS BIGINT) AS length, 'bin-' || CASE lang WHEN 'en' THEN 'x86_64' WHEN 'de' THEN 'i686' ELSE 'arm' END || '-O2' AS filename
           FROM documents WHERE strlen(text) < 5000 AND lang IN ('en', 'de') AND source NOT IN ('src0', 'src3')""",
    ),
    "exclusion_filter": (exclusion_filter, "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')"),
    "sequential_id": (sequential_id, "SELECT s_name, CAST(row_number() OVER (ORDER BY s_name) - 1 AS VARCHAR) AS id FROM supplier"),
    "split_train_valid": (split_train_valid, f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN {_DOC_BUCKET} < 0.9 THEN 'train' ELSE 'valid' END AS part FROM documents"),
    "split_three_way": (
        split_three_way,
        f"SELECT CASE WHEN {_DOC_BUCKET} < 0.8 THEN 'train' WHEN {_DOC_BUCKET} < 0.9 THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM documents GROUP BY 1",
    ),
    "random_split": (random_split, None),
    "reader_striping": (reader_striping, "SELECT doc_id, source FROM (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS r FROM documents) WHERE r % 3 = 1"),
    "dataset_len": (dataset_len, "SELECT count(*) AS rows FROM lineitem"),
    "multi_path_scan": (multi_path_scan, "SELECT r_regionkey, CAST(2 AS BIGINT) AS n FROM region"),
    "generate_numbers": (
        generate_numbers,
        f"SELECT id, number, 1.0::DOUBLE / number AS reciprocal FROM (SELECT i AS id, CAST(floor({_bucket(42, 'CAST(i AS VARCHAR)')} * 4096) AS INTEGER) + 1 AS number FROM range(64) t(i))",
    ),
    "reciprocal": (reciprocal, "SELECT l_quantity, count(*) AS n, 1.0::DOUBLE / l_quantity AS reciprocal FROM lineitem GROUP BY l_quantity"),
}
