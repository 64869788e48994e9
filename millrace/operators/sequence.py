"""Operators on ordered sequences: instruction features, padding, masks, pooling, metrics.

Arrays stay arrays: each is one expression per row, with no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MASK, NEXT, PAD
from ..schema import require
from .frame import number

#: Fixed value: the label that a loss ignores.
IGNORE = -100
#: Sizes of the encoder that datasets are made for, by name.
ENCODERS = {
    "medium": {"sequence_length": 512, "depth": 12, "heads": 12, "hidden_dimensions": 768, "intermediate_dimensions": 3072, "dropout": 0.1, "eps": 1e-12},
}


def _ends(tokens: Column, next_id: int | str) -> Column:
    """Position after each instruction: after every ``next_id``, and the end of the sequence."""
    at = F.transform(tokens, lambda t, i: F.when((t == next_id) | (i == F.size(tokens) - 1), i + 1))
    return F.filter(at, lambda x: x.isNotNull())


def _start(ends: Column, k: Column) -> Column:
    return F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))


def instruction_index(tokens: Column, ends: Column) -> Column:
    """For each position the number of instructions that ended before it; an end belongs to the one it ends."""
    return F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - _start(ends, k))))


def argument_index(tokens: Column, ends: Column) -> Column:
    """For each position how far it lies from the start of its instruction."""
    return F.flatten(F.transform(ends, lambda e, k: F.sequence(F.lit(0), e - _start(ends, k) - 1)))


def with_positions(df: DataFrame, column: str = "tokens", next_id: int | str = NEXT) -> DataFrame:
    """Add ``instruction, argument, position``, three arrays as long as ``column``."""
    require(df, (column,))
    t, ends = F.col(column), F.col("_ends")
    out = df.withColumn("_ends", _ends(t, next_id))
    return (
        out.withColumn("instruction", instruction_index(t, ends))
        .withColumn("argument", argument_index(t, ends))
        .withColumn("position", F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>")))
        .drop("_ends")
    )


def model_input(df: DataFrame, length: int = 512, vocabulary: int | None = None, next_id: int = NEXT, column: str = "tokens") -> DataFrame:
    """:func:`with_positions` of rows that a model of a fixed length takes.

    A column that is no array of whole numbers raises ``ValueError`` as the plan is made. A row of another length, with a null, or with an id
    outside the ``vocabulary`` raises when it is computed, naming what it has.
    """
    require(df, (column,))
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"expected rows of token ids but {column!r} is {kind.simpleString()}")
    t = F.col(column)
    wrong = lambda text, x: F.raise_error(F.concat(F.lit(text), x.cast("string"))).cast(kind)
    checked = F.when(F.coalesce(F.size(t), F.lit(-1)) != length, wrong(f"expected {length} tokens, not ", F.coalesce(F.size(t), F.lit(-1))))
    inside = lambda x: F.coalesce((x >= 0) & (x < (vocabulary if vocabulary is not None else 1 << 62)), F.lit(False))
    checked = checked.when(~F.forall(t, inside), wrong("expected ids of the vocabulary, not ", F.to_json(F.filter(t, lambda x: ~inside(x)))))
    return with_positions(df.withColumn(column, checked.otherwise(t)), column, next_id)


def fixed_length(tokens: Column, length: int = 512, pad: int | str = PAD) -> Column:
    """Cut or pad on the right to ``length``."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def attention(tokens: Column, length: int = 512) -> Column:
    """1 for each token within ``length``, then 0."""
    n = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts, so that reruns and engines agree."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(2**32)


def mask_tokens(df: DataFrame, vocabulary: int, probability: float = 0.15, seed: int = 42, mask_id: int = MASK, key: str = "id") -> DataFrame:
    """Masked-model training rows: ``tokens`` with some replaced, ``labels`` with the original there.

    A position with ``mask`` 1 is a candidate with ``probability``. Of the candidates 80 % become the mask
    token, 10 % a random id, and 10 % stay; labels elsewhere are ``IGNORE``. Draws come from a hash of
    seed, key and position.
    """
    require(df, (key, "tokens", "mask"))
    draw = lambda kind, i: uniform(F.lit(seed), F.col(key), i, F.lit(kind))

    def drawn(x: Column, i: Column) -> Column:
        t, way = x["t"], draw("way", i)
        other = F.floor(draw("id", i) * vocabulary).cast("int")
        new = F.when(way < 0.8, F.lit(mask_id)).when(way < 0.9, other).otherwise(t)
        chosen = (x["m"] == 1) & (draw("pick", i) < F.lit(probability))
        return F.when(chosen, F.struct(new.alias("token"), t.alias("label"))).otherwise(F.struct(t.alias("token"), F.lit(IGNORE).alias("label")))

    # tokens and masks walk together, each draw is made once: a column that is looked up by place in a lambda may be computed anew for every place
    pairs = F.arrays_zip(F.col("tokens").alias("t"), F.coalesce("mask", F.array()).alias("m"))
    out = df.withColumn("_drawn", F.transform(F.slice(pairs, 1, F.size("tokens")), drawn))
    return out.withColumn("tokens", F.col("_drawn.token")).withColumn("labels", F.col("_drawn.label")).select(*df.columns, "labels")


def fill_masked(tokens: Column, predicted: Column, mask_id: int = MASK) -> Column:
    """Predictions where the mask token stands, the tokens themselves elsewhere."""
    return F.zip_with(tokens, predicted, lambda t, p: F.when(t == mask_id, p).otherwise(t))


def argmax(scores: Column) -> Column:
    """Position of the largest value, counted from 0; the first of several."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def masked_mean(values: Column, mask: Column | None = None) -> Column:
    """Mean of the values where the mask is 1, over at least one; the plain mean without a mask."""
    x = F.transform(values, lambda v: v.cast("double"))
    if mask is None:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    m = F.transform(mask, lambda v: v.cast("double"))
    top = F.aggregate(F.zip_with(x, m, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return top / F.greatest(F.aggregate(m, F.lit(0.0), lambda a, v: a + v), F.lit(1.0))


def micro_f1(predicted: Column, reference: Column) -> Column:
    """Micro-averaged F1 of single labels, an aggregate: the share of equal pairs, where the reference is not ``IGNORE``."""
    return F.avg(F.when(reference != IGNORE, (predicted == reference).cast("double")))


def cross_entropy(probability: Column) -> Column:
    """Mean negative log-likelihood of the probabilities given to the right labels, an aggregate."""
    return F.avg(-F.log(probability))


def collate(df: DataFrame) -> DataFrame:
    """What a classification batch holds of each row."""
    require(df, ("tokens", "mask", "label"))
    return df.select("tokens", "mask", "label")


def batches(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """``batch, rows`` and, for every column of ``df``, an array of exactly ``size`` values in the order of ``order``; the last batch may be shorter.

    Rows are numbered across partitions, so a batch does not depend on how they were dealt out, and one task holds no more than a batch.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    rows = number(df, "_place", *order)
    grouped = rows.groupBy(F.floor(F.col("_place") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_place", *df.columns))).alias("_r"))
    return grouped.select("batch", F.size("_r").alias("rows"), *[F.col(f"_r.{c}").alias(c) for c in df.columns])
