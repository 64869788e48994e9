"""The registered query of each operator: its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, centroids, fingerprints, langid, minhash, mixing, oracles, packing, pii, quality, scoring, sharding, urlfilter, warc
from .common import remainder, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    langs, model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, langs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs", "fit")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return scoring.train_and_score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts: what a curated blocklist would be, derived from digests of the names.

    Half the hosts are listed from some day of 2023, half of those are removed later and some return;
    registered domains are listed for one spell of a season, and a first path step of a host now and then.
    """
    host = urlfilter.url_host(F.col("url"))
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    digit = lambda x, k: F.conv(F.substring(F.md5(x.cast("binary")), k, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n).cast("timestamp_ntz")
    x = F.col("host")
    cat = F.element_at(F.array(*map(F.lit, ("spam", "malware", "adult"))), F.pmod(digit(x, 9), F.lit(3)) + 1)
    event = lambda n, action: F.struct(day(n).alias("at"), (F.lit(action) if isinstance(action, str) else action).alias("action"))
    log = F.array(
        event(digit(x, 3), "add"),
        event(digit(x, 3) + digit(x, 5) + 1, F.when(digit(x, 5) < 128, "remove").otherwise("add")),
        event(digit(x, 3) + digit(x, 5) + digit(x, 7) + 2, F.when(digit(x, 7) < 64, "add").otherwise("remove")),
    )
    some = hosts.filter(digit(x, 1) < 128).select(F.lit("host").alias("kind"), x.alias("pattern"), cat.alias("category"), F.explode(log).alias("e"))
    parent = F.substring_index("host", ".", -2)
    domains = hosts.select(parent.alias("pattern")).distinct().select(
        F.lit("domain").alias("kind"), "pattern", F.lit("season").alias("category"),
        F.explode(F.array(event(F.length("pattern") * 10, "add"), event(F.length("pattern") * 10 + 60, "remove"))).alias("e"),
    )
    step = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*(/[^/?#]*/)", 1)
    paths = pages.select(F.concat(host, step).alias("pattern"), step.alias("step")).filter("step <> '' and pattern is not null").select("pattern").distinct()
    paths = paths.filter(digit(F.col("pattern"), 1) < 32).select(
        F.lit("prefix").alias("kind"), "pattern", F.lit("section").alias("category"), F.explode(F.array(event(digit(F.col("pattern"), 3), "add"))).alias("e")
    )
    return some.union(domains).union(paths).select("kind", "pattern", "category", "e.at", "e.action")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).cast("timestamp_ntz")
    return urlfilter.judge(pages.withColumn("fetched_at", fetched), list_changes(pages)).withColumn("host", urlfilter.url_host(F.col("url")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_langid, op2_packing, op3_mixing, op4_warc, op5_scoring, op6_fingerprints, op7_urlfilter, op8_minhash, op9_sharding, op10_quality,
        op11_filter_audit, op12_pii, op13_centroids,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
