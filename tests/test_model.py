from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import sequence, split, tokens


@pytest.mark.parametrize(
    ("ids", "instruction", "argument"),
    [
        ([1, 2, 0, 3, 0, 4, 5], [0, 0, 0, 1, 1, 2, 2], [0, 1, 2, 0, 1, 0, 1]),
        ([1, 2, 3, 4], [0, 0, 0, 0], [0, 1, 2, 3]),
        ([0, 1, 2], [0, 1, 1], [0, 0, 1]),
        ([1, 0, 2], [0, 0, 1], [0, 1, 0]),
        ([0, 0], [0, 1], [0, 0]),
        ([], [], []),
    ],
)
def test_positions(spark, ids, instruction, argument):
    row = sequence.with_positions(spark.createDataFrame([(ids,)], "tokens array<int>"), next_id=0).first()
    assert (row.instruction, row.argument, row.position) == (instruction, argument, list(range(len(ids))))


def test_pad_and_mask(spark):
    df = spark.createDataFrame([([7, 8],), ([1, 2, 3, 4, 5],)], "t array<int>").select(sequence.fixed_length(F.col("t"), 4).alias("t"), sequence.attention(F.col("t"), 4).alias("m"))
    assert [(r.t, r.m) for r in df.collect()] == [([7, 8, 0, 0], [1, 1, 0, 0]), ([1, 2, 3, 4], [1, 1, 1, 1])]


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(str(k), list(range(1, 17)), [1] * 12 + [0] * 4) for k in range(50)], "id string, tokens array<int>, mask array<int>")


def test_masking_extremes(batch):
    for row in sequence.mask_tokens(batch, 100, probability=0.0).collect():
        assert row.tokens == list(range(1, 17)) and set(row.labels) == {-100}
    rows = sequence.mask_tokens(batch, 100, probability=1.0).collect()
    for row in rows:
        assert row.labels == list(range(1, 13)) + [-100] * 4 and row.tokens[12:] == [13, 14, 15, 16]
    share = sum(t == 4 for r in rows for t in r.tokens[:12]) / (12 * len(rows))
    assert 0.7 < share < 0.9


def test_masking_does_not_depend_on_partitions(batch):
    f = lambda df: sorted(map(str, sequence.mask_tokens(df, 100).collect()))
    assert f(batch) == f(batch.repartition(3))


def test_masking_draws_once_a_place(batch):
    """However few columns are wanted, no draw is made for all places at each place: no line of the plan walks along a row within a walk along it."""
    for columns in (["tokens"], ["labels"], ["tokens", "labels"]):
        plan = sequence.mask_tokens(batch, 100).select("id", *columns)._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2(" in plan and all(line.count("transform(") <= 1 for line in plan.splitlines())


def test_counts(spark):
    df = spark.createDataFrame([("1", "f", "xor eax eax [NEXT] add eax ebx [NEXT] sub eax 42")], "id string, name string, disassembly string")
    got = {(r.kind, r.token): r.n for r in tokens.preprocess_tokens(df).collect()}
    assert got["tokens", "eax"] == 4 and got["immediates", "42"] == 1
    merged = {r.token: r.n for r in tokens.merge_counts(tokens.preprocess_tokens(df), tokens.preprocess_tokens(df)).collect()}
    assert merged["eax"] == 8


def test_merged_counts_of_documents_without_language(spark, tmp_path):
    from millrace.plans import queries_model

    rows = [("a b", "en"), ("b c", None), ("c c", "xx")]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.n for r in queries_model.token_counts_merged(spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_tokenizer(spark):
    counts = spark.createDataFrame([("tokens", "xor", 1), ("tokens", "add", 1), ("tokens", "eax", 3), ("immediates", "42", 1)], "kind string, token string, n long")
    t = tokens.train_tokenizer(counts, length=8)
    assert {k: t.ids[k] for k in ("2", "4", "__2", "42")} == {"2": 6, "4": 7, "__2": 8, "42": 9}
    assert t.encode("xor eax 42") == ([t.ids["xor"], t.ids["eax"], 9, 0, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0])
    assert t.encode_all("300") == [1, 1, 1]
    assert t.encode_all("addeax") == [t.ids["add"], t.ids["eax"]]
    assert tokens.Tokenizer.load(t.save()).encode("xor 42") == t.encode("xor 42")
    df = spark.createDataFrame([("1", "f", "xor eax 42 [NEXT] add eax 42")], "id string, name string, disassembly string")
    row = tokens.tokenize(df, t).first()
    assert row.mask == [1] * 7 + [0]
    assert tokens.detokenize(tokens.tokenize(df, t), t).first().text == "xor eax 42 [NEXT] add eax 42 [PAD]"


def test_tokenizer_learns_from_all_counts(spark):
    """More distinct immediates and whole tokens than the driver merges: the same tokenizer."""
    words = [("immediates", str(k * 7919 % 10007), 1 + k % 3) for k in range(300)] + [("immediates", "-9999_999", 4)]
    counts = spark.createDataFrame(words + [("tokens", f"t{k}", 1) for k in range(20)], "kind string, token string, n long").repartition(3)
    want, got = tokens.train_tokenizer(counts, size=50), tokens.train_tokenizer(counts, size=50, most_words=5)
    assert len(got.merges) > 16 and len(got.whole) == 20
    assert got.save() == want.save()


def test_columns_are_encoded_like_values():
    """Arrays give what one value after another gives: runs of equal pieces, unknown pieces, symbols, whole tokens inside words, long rows, nulls."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    words = {"".join(rng.choice("1123") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(200)}
    ids = {t: k for k, t in enumerate(tokens.text.SPECIAL_TOKENS)}
    merges = tokens.learn_merges(words, ids, 60)
    ids |= {w: len(ids) + k for k, w in enumerate(["xor", "r1", "opA", "a\u00a0b"])}
    make = lambda: tokens.Tokenizer(ids, merges, ["xor", "r1", "opA", "a\u00a0b"], 12)
    parts = [*words, "1111111", "4", "+12_1", "xor", "r1", "opA", "12r13", "xor11", "[NEXT]", "é1", "a\u00a0b", "\u00a0", "--"]
    values = [rng.choice([" ", "\t", "  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", " ", " 11 ", None]
    got, one = make().encode_batch(pa.array(values)), make()
    want = [one.encode(v or "") for v in values]
    assert (got[0].tolist(), got[1].tolist()) == ([w[0] for w in want], [w[1] for w in want])
    assert [len(x) for x in make().encode_batch(pa.array([], pa.string()))] == [0, 0]


def test_merges_like_the_public_library():
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    words = {"1234": 5, "123": 4, "12": 9, "3412": 2, "9999": 3, "34": 6}
    ids = {t: k for k, t in enumerate(tokens.text.SPECIAL_TOKENS)}
    tokens.learn_merges(words, ids, 30)
    public = Tokenizer(models.BPE(unk_token="[UNK]", continuing_subword_prefix="__"))
    public.pre_tokenizer = pre_tokenizers.Whitespace()
    public.train_from_iterator([w for w, n in words.items() for _ in range(n)], trainers.BpeTrainer(vocab_size=30, special_tokens=list(tokens.text.SPECIAL_TOKENS), continuing_subword_prefix="__", show_progress=False))
    assert set(ids) == set(public.get_vocab())


def test_collated_tokens_of_single_precision(spark, sf, tmp_path):
    """Products that single precision rounds to a whole number and double precision does not."""
    import numpy as np

    from millrace.plans import queries_model

    from .oracle import spark_rows, sql_rows

    x = [float(v) for v in (np.arange(-100, 100) / np.float32(100)).astype(np.float32)]
    assert any(np.floor(np.float32(v) * np.float32(100)) != np.floor(v * 100) for v in x)
    rows = [(k, (x[k:] + x[:k])[:64], k % 3) for k in range(0, 200, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    file = next((tmp_path / "embeddings.parquet").glob("part-*"))
    for name in ("collate_classification", "collate_batches"):
        run, sql = queries_model.QUERIES[name]
        assert spark_rows(run(spark, str(tmp_path))) == sql_rows(sql.replace("FROM embeddings", f"FROM read_parquet('{file}')"), sf)


def test_pool_argmax_f1(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0], [1, 1, 0]), ([1.0, 2.0, 3.0], [0, 0, 0])], "v array<double>, m array<int>")
    rows = df.select(sequence.masked_mean(F.col("v"), F.col("m")).alias("p"), sequence.masked_mean(F.col("v")).alias("q"), sequence.argmax(F.col("v")).alias("a")).collect()
    assert [(r.p, r.q, r.a) for r in rows] == [(1.5, 4.0, 2), (0.0, 2.0, 2)]
    labels = spark.createDataFrame([(1, 1), (0, 1), (5, -100)], "p int, r int")
    assert labels.agg(sequence.micro_f1(F.col("p"), F.col("r")).alias("f")).first().f == 0.5


def test_splits(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    parts = split.hash_split(df, {"train": 90, "valid": 10})
    n = {k: v.count() for k, v in parts.items()}
    assert sum(n.values()) == 1000 and abs(n["train"] / 1000 - 0.9) < 0.05
    assert parts["train"].join(parts["valid"], "id").count() == 0
    with pytest.raises(ValueError):
        split.hash_split(df, {"a": 50})[0]
    paths = split.write_splits(df, f"{tmp_path}/out", {"train": 80, "valid": 10, "test": 10})
    assert sum(spark.read.parquet(p).count() for p in paths.values()) == 1000


def test_parse():
    import argparse

    assert split.parse_split("train:90") == ("train", 90.0)
    assert split.parse_rename("a:b") == ("a", "b")
    for bad in ("train", "train:x", ":5"):
        with pytest.raises(argparse.ArgumentTypeError):
            split.parse_split(bad)
    with pytest.raises(argparse.ArgumentTypeError):
        split.parse_rename("ab")


def test_stripes_cover_all_files(spark):
    df = spark.createDataFrame([(k, f"f{k % 5}") for k in range(20)], "id int, file string")
    parts = [{r.id for r in split.stripe(df, "file", w, 2).collect()} for w in range(2)]
    assert parts[0] | parts[1] == set(range(20)) and not parts[0] & parts[1]
