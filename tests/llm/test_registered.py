"""Registered queries: against SQL where there is any, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import queries

from ..oracle import spark_rows, sql_rows
from .test_documents import brute_components, brute_targets

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got_names, got = spark_rows(QUERIES[name](spark, sf))
    names, want = sql_rows(SQL[name], sf)
    assert got_names == names and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, sf, name):
    df = QUERIES[name](spark, sf)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    whole = spark.read.parquet(f"{sf}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    once = df.filter("piece = 0") if "piece" in df.columns else df
    assert Counter(r[0] for r in once.select(key).collect()) == Counter(r[0] for r in whole.select(key).collect())


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_langid"](spark, sf).join(docs, "doc_id").filter("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stage(function(spark, before, sf), f"test-{k}")
        seen.append((before, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for before, after in seen[:3]:
        assert not ids(after) - ids(before)
    # near duplicates: one of each group stays
    before, after = seen[2]
    want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert set(ids(after)) == {i for i, c in want.items() if i == c}
    # mixing: each source comes near its target
    before, after = seen[3]
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))).alias("n")).collect()}
    sizes, taken = words(before), words(after)
    longest = defaultdict(int)
    for r in before.collect():
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= longest[s]
    assert max(ids(after).values()) <= 3
    # packing: every copy of every document is there, in sequences that fit
    before, after = seen[4]
    assert ids(after.filter("piece = 0")) == ids(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert spark_rows(corpus_pipeline.run(spark, sf).drop("sequence_id", "offset")) == spark_rows(after.drop("sequence_id", "offset"))


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels for some of the odd documents."""
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(k, k % 5 and 1, 0) for k in range(0, 60, 2)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_of_any_name(spark, docs, clashing, labelled, k):
    """Nulls, repeats, ties, long texts, and columns that have the names stages use inside."""
    stage = corpus_pipeline.STAGES[k][1]
    own = ["base_failed", "mix_copies", "mix_copy", "copies", "fit", "text_key", "aside_0_", "n_upper"]
    more = clashing.drop("copies", "base_failed").select("*", *[F.lit(f"own {n}").alias(n) for n in own])
    key = ["doc_id", "text"] if k < 4 else ["doc_id", "piece", "length", "ids_crc32"]
    plain, wide = stage(spark, docs, labelled), stage(spark, more, labelled)
    found = lambda df: Counter(tuple(r) for r in df.select(*key).collect())
    assert found(plain) == found(wide)
    if k < 4:
        assert wide.columns == more.columns
        assert wide.select(*own).distinct().collect() == [tuple(f"own {n}" for n in own)]
        rows = Counter(tuple(r) for r in docs.collect())
        assert all(r in rows for r in Counter(tuple(r) for r in plain.collect()))


def test_stage_languages_rejects_what_fits_none(spark, docs, labelled):
    more = [(2000, "日本語 の 文 です それ は 学習 されて いない 言葉", None, "s0", 1), (2001, "xqzj vvkq wqxz jqqx zzxv kqjx " * 5, None, "s0", 1), (2002, "the of and to in der die und zu von", None, "s0", 1)]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, every, labelled).collect()}
    assert set(range(60)) | {64, 65, 66, 2002} <= got and not got & {60, 61, 62, 63, 2000, 2001}


def test_stage_near_duplicates_goes_by_rows(spark, labelled):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (1, b), (1, b + " b"), (3, c), (3, c), (None, c), (None, c), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, labelled).collect())
    families = [{(0, a), (1, a)}, {(1, b), (1, b + " b")}, {(3, c)}]
    assert [sum(got[x] for x in f) for f in families] == [1, 1, 1] and got[0, a] == 1
    assert all(got[x] == 2 for x in ((None, c), (4, ""))) and got[5, None] == 1


def test_mixing_goes_by_rows(spark, labelled):
    """Rows of one doc_id with texts of different sizes are each taken as the plan says for it."""
    df = spark.createDataFrame([(k // 2, "w " * (1 + k % 7), f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    words = F.size(F.split(F.trim("text"), " "))
    want = Counter()
    for r in queries.mixing.mix(df).select("doc_id", "source", "size", "copies").collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, r.n) for r in queries.mixing.mixed(df).select("doc_id", "source", words.alias("n")).collect())
    assert got == +want


def test_pipeline_leaves_only_its_result(spark, sf, tmp_path_factory):
    import os

    from millrace.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, sf).count()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"pipeline-5", "near-gone", "near-again", "mix-plan", "quality-labels"}


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
