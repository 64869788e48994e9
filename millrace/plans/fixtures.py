"""Tables of the driver's datasets, and what the queries derive from them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("source"), "doc_id")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions: an instruction for each line item."""
    step = F.concat(F.lit("op"), "l_returnflag", F.lit(" r"), "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", step.alias("step"))))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    return grouped.select(
        F.col("l_orderkey").cast("string").alias("id"), F.lit("main").alias("name"), F.array_join(F.transform("rows", lambda r: r["step"]), " [NEXT] ").alias("disassembly")
    )


TRACES = """
  SELECT CAST(l_orderkey AS VARCHAR) AS id, 'main' AS name,
         string_agg('op' || l_returnflag || ' r' || l_linestatus || ' ' || CAST(l_partkey AS VARCHAR), ' [NEXT] ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS disassembly
  FROM lineitem GROUP BY l_orderkey"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as completions of an inference service."""
    state = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.lit(0).alias("type"), F.col("props").alias("input"), F.lit(None).cast("string").alias("output"),
        F.col("ts").alias("timestamp"), state.alias("state"),
        F.when(F.col("value") < 50, F.floor(F.col("value") / 10).cast("int")).alias("rating"), F.lit(None).cast("string").alias("comments"),
    )


QUEUE = """
  SELECT event_id AS id, user_id, 0 AS type, props AS input, CAST(NULL AS VARCHAR) AS output, ts AS timestamp,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS state,
         CASE WHEN value < 50 THEN CAST(floor(value / 10) AS INTEGER) END AS rating, CAST(NULL AS VARCHAR) AS comments
  FROM events"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 9000).alias("admin"))


USERS = "SELECT c_custkey AS id, c_name AS username, c_acctbal > 9000 AS admin FROM customer"


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as completions: some users have none of the pending ones, some ratings are missing."""
    state = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    rating = F.when(F.col("o_orderpriority").startswith("5"), None).otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.lit(0).alias("type"), F.col("o_orderpriority").alias("input"),
        F.col("o_orderstatus").alias("output"), F.col("o_orderdate").alias("timestamp"), state.alias("state"), rating.alias("rating"),
        F.lit(None).cast("string").alias("comments"),
    )


COMPLETIONS = """
  SELECT o_orderkey AS id, o_custkey AS user_id, 0 AS type, o_orderpriority AS input, o_orderstatus AS output, o_orderdate AS timestamp,
         CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS state,
         CASE WHEN starts_with(o_orderpriority, '5') THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 END AS rating,
         CAST(NULL AS VARCHAR) AS comments
  FROM orders"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as attempts: a competitor for each, in one language per role, with a verdict per turn so far."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("competitor"), F.col("turn").alias("i"),
        F.when(F.col("role") == "user", "CPP").when(F.col("role") == "system", "C").otherwise("Python").alias("language"), "text",
    )


ATTEMPTS = """
  SELECT conv_id AS competitor, turn AS i, CASE role WHEN 'user' THEN 'CPP' WHEN 'system' THEN 'C' ELSE 'Python' END AS language, text FROM conversations"""


def vulnerability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of vulnerable functions: two names each, some with versions."""
    p = table(spark, sf_dir, "part")
    versions = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, F.array(F.lit("O"))).otherwise(F.array(F.lit("F"), F.lit("O")))
    return p.select(
        F.when(F.col("p_partkey") % 2 == 0, "N").otherwise("R").alias("repo"), F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("cve_name"),
        F.array(F.concat(F.lit(" "), F.upper("p_name")), F.col("p_name")).alias("function_names"), versions.alias("binary_version"), F.col("p_partkey").alias("ord"),
    )


VULNERABILITIES = r"""
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'R' END AS project, lower(trim(n.name)) AS fname, 'CVE-' || CAST(p_size AS VARCHAR) AS cve_name,
         v.version, p_partkey AS ord, n.i, v.j
  FROM part,
       (VALUES (0), (1)) AS k(i),
       LATERAL (SELECT k.i, CASE k.i WHEN 0 THEN ' ' || upper(p_name) ELSE p_name END AS name) AS n,
       LATERAL (SELECT unnest(CASE p_size % 3 WHEN 0 THEN ['-'] WHEN 1 THEN ['O'] ELSE ['F', 'O'] END) AS version,
                       unnest(CASE p_size % 3 WHEN 0 THEN [0] WHEN 1 THEN [0] ELSE [0, 1] END) AS j) AS v"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as functions of projects in versions, named like parts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("project"),
        F.col("p_name").alias("name"), F.col("l_linestatus").alias("version"),
    )


FUNCTIONS = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS project, p_name AS name, l_linestatus AS version
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, claims and answers for the rows of a queue, one for each user, by three workers."""
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type").isin("click", "view"), "claim").otherwise("submit")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("action"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker"),
    )


QUEUE_EVENTS = """
  SELECT user_id AS id, ts AS happened, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'finish' WHEN event_type IN ('click', 'view') THEN 'claim' ELSE 'submit' END AS action,
         'w' || CAST(event_id % 3 AS VARCHAR) AS worker
  FROM events"""
