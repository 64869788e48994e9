"""Queries of tokenisation and model data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import sequence, tokens
from . import fixtures as fx
from . import pipelines
from .fixtures import table
from .queries_pipeline import _bucket

LENGTH = 32


def token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), "text")


def token_counts_merged(spark, sf):
    docs = table(spark, sf, "documents")
    parts = [tokens.count_tokens(docs.filter(F.col("lang") == x), "text") for x in ("en", "de", "fr", "es")]
    return tokens.merge_counts(*parts, tokens.count_tokens(docs.filter(~F.coalesce("lang", F.lit("")).isin("en", "de", "fr", "es")), "text"))


def immediates(spark, sf):
    return tokens.preprocess_tokens(fx.traces(spark, sf)).filter("kind = 'immediates'").select("token", "n")


def unique_token_count(spark, sf):
    return tokens.unique_tokens(tokens.count_tokens(table(spark, sf, "documents"), "text"))


def counts_json(spark, sf):
    return tokens.counts_json(tokens.preprocess_tokens(fx.traces(spark, sf)))


def build_traces(spark, sf):
    return fx.traces(spark, sf)


def _lists(spark, sf):
    return fx.traces(spark, sf).select("id", text.tokens(F.col("disassembly")).alias("tokens"))


def instruction_index(spark, sf):
    return sequence.with_positions(_lists(spark, sf), next_id="[NEXT]").select("id", "instruction")


def argument_index(spark, sf):
    return sequence.with_positions(_lists(spark, sf), next_id="[NEXT]").select("id", "argument")


def position_ids(spark, sf):
    return sequence.with_positions(_lists(spark, sf), next_id="[NEXT]").select("id", "position")


def pad_truncate_mask(spark, sf):
    t = F.col("tokens")
    return _lists(spark, sf).select("id", sequence.fixed_length(t, LENGTH, "[PAD]").alias("padded"), sequence.attention(t, LENGTH).alias("mask"))


def vocabulary_ids(spark, sf):
    return tokens.vocabulary_ids(tokens.preprocess_tokens(fx.traces(spark, sf)))


def _numbered(spark, sf):
    """Traces as ids: each token's last two digits, or its length, on top of the special ones."""
    ids = F.transform("tokens", lambda t: F.when(t == "[NEXT]", text.NEXT).when(text.is_immediate(t), 6 + t.cast("int") % 50).otherwise(60 + F.length(t)))
    rows = _lists(spark, sf).withColumn("ids", ids)
    return rows.select("id", sequence.fixed_length(F.col("ids"), LENGTH).alias("tokens"), sequence.attention(F.col("ids"), LENGTH).alias("mask"))


_NUMBERED = rf"""
  SELECT id, (ids || list_transform(range({LENGTH}), lambda i: 0))[:{LENGTH}] AS tokens,
         list_transform(range({LENGTH}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS mask
  FROM (SELECT id, list_transform(string_split(disassembly, ' '), lambda t: CAST(CASE WHEN t = '[NEXT]' THEN 5
          WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') THEN 6 + TRY_CAST(t AS INTEGER) % 50 ELSE 60 + length(t) END AS INTEGER)) AS ids FROM ({fx.TRACES}))"""


def mlm_mask_deterministic(spark, sf):
    return sequence.mask_tokens(_numbered(spark, sf), vocabulary=100)


def _hundredths(values):
    """Whole hundredths of single-precision numbers, multiplied as such: in double precision some products fall to the other side of a whole number."""
    return F.transform(values, lambda x: F.floor(x * F.lit(100).cast("float")).cast("int"))


def collate_batches(spark, sf):
    """Training batches of 48 rows, the last one shorter."""
    rows = table(spark, sf, "embeddings").select("vec_id", _hundredths(F.col("embedding")).alias("tokens"), "label")
    return sequence.batches(rows, 48, "vec_id").select("batch", F.col("rows").cast("long").alias("rows"), F.col("vec_id").alias("ids"), F.col("label").alias("labels"), F.transform("tokens", lambda t: t[0]).alias("firsts"))


def collate_classification(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        _hundredths(F.col("embedding")).alias("tokens"), F.array_repeat(F.lit(1), 64).alias("mask"), "label"
    )
    return sequence.collate(rows)


def masked_mean_pool(spark, sf):
    e = table(spark, sf, "embeddings")
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 4 == F.col("vec_id") % 4, 0).otherwise(1))
    return e.select("vec_id", sequence.masked_mean(F.col("embedding"), mask).alias("pooled"), sequence.masked_mean(F.col("embedding")).alias("mean"))


def argmax_position(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", sequence.argmax(F.col("embedding")).alias("best"))


def fill_masked(spark, sf):
    rows = sequence.mask_tokens(_numbered(spark, sf), vocabulary=100)
    predicted = F.transform("tokens", lambda t, i: (i + 7).cast("int"))
    return rows.select("id", sequence.fill_masked(F.col("tokens"), predicted).alias("filled"))


def micro_f1(spark, sf):
    return table(spark, sf, "labels").agg(sequence.micro_f1(F.col("toxic"), F.col("quality")).alias("f1"))


def cross_entropy(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(sequence.cross_entropy(F.lit(1.0) - F.col("l_discount") - F.col("l_tax")), 9).alias("loss"))


def bpe_encode(spark, sf):
    """Fit on the traces, then encode them."""
    rows = fx.traces(spark, sf)
    return tokens.tokenize(rows, pipelines.train_tokenizer(rows, LENGTH, 256)).select("id", "tokens", "mask")


def bpe_round_trip(spark, sf):
    """Decoded ids, immediates in their pieces."""
    rows = fx.traces(spark, sf)
    tokenizer = pipelines.train_tokenizer(rows, 512, 256)
    return tokens.detokenize(tokens.tokenize(rows, tokenizer), tokenizer).select("id", text.strip_padding(F.col("text")).alias("text"))


def probes(spark, sf):
    return pipelines.probes(spark)


_KIND = r"CASE WHEN regexp_full_match(token, '[+-]?[0-9]+(_[0-9]+)*') THEN 'immediates' ELSE 'tokens' END"
_COUNTS = f"SELECT {_KIND} AS kind, token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM documents) GROUP BY 1, 2"
_TRACE_COUNTS = f"SELECT {_KIND} AS kind, token, count(*) AS n FROM (SELECT unnest(string_split(disassembly, ' ')) AS token FROM ({fx.TRACES})) GROUP BY 1, 2"
_POSITIONS = f"""
  SELECT id, k - 1 AS pos, t[k] AS token,
         CAST(coalesce(sum(CASE WHEN t[k] = '[NEXT]' THEN 1 ELSE 0 END) OVER before, 0) AS INTEGER) AS instruction,
         CAST(k - 1 - coalesce(max(CASE WHEN t[k] = '[NEXT]' THEN k END) OVER before, 0) AS INTEGER) AS argument
  FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT id, string_split(disassembly, ' ') AS t FROM ({fx.TRACES})))
  WINDOW before AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_DRAW = lambda kind: _bucket(42, "id, CAST(i AS VARCHAR), ", f"'{kind}'")
_CHOSEN = f"mask[i + 1] = 1 AND {_DRAW('pick')} < 0.15"
_MASKED = f"""
  SELECT id, list_transform(range({LENGTH}), lambda i: CAST(CASE WHEN {_CHOSEN} THEN
             CASE WHEN {_DRAW("way")} < 0.8 THEN 4 WHEN {_DRAW("way")} < 0.9 THEN floor({_DRAW("id")} * 100) ELSE tokens[i + 1] END
           ELSE tokens[i + 1] END AS INTEGER)) AS tokens, mask,
         list_transform(range({LENGTH}), lambda i: CASE WHEN {_CHOSEN} THEN tokens[i + 1] ELSE -100 END) AS labels
  FROM ({_NUMBERED})"""
_SUM = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda a, b: a + b)".format

QUERIES = {
    "token_counts": (token_counts, _COUNTS),
    "token_counts_merged": (token_counts_merged, _COUNTS),
    "immediates": (immediates, f"SELECT token, n FROM ({_TRACE_COUNTS}) WHERE kind = 'immediates'"),
    "unique_token_count": (unique_token_count, f"SELECT count(*) AS unique_tokens FROM ({_COUNTS})"),
    "counts_json": (
        counts_json,
        f"""SELECT '{{"tokens":{{' || string_agg('"' || token || '":' || n, ',' ORDER BY token) FILTER (kind = 'tokens')
            || '}},"immediates":{{' || string_agg('"' || token || '":' || n, ',' ORDER BY token) FILTER (kind = 'immediates') || '}}}}' AS value FROM ({_TRACE_COUNTS})""",
    ),
    "build_traces": (build_traces, fx.TRACES),
    "instruction_index": (instruction_index, f"SELECT id, list(instruction ORDER BY pos) AS instruction FROM ({_POSITIONS}) GROUP BY id"),
    "argument_index": (argument_index, f"SELECT id, list(argument ORDER BY pos) AS argument FROM ({_POSITIONS}) GROUP BY id"),
    "position_ids": (position_ids, f"SELECT id, list(CAST(pos AS INTEGER) ORDER BY pos) AS position FROM ({_POSITIONS}) GROUP BY id"),
    "pad_truncate_mask": (
        pad_truncate_mask,
        f"""SELECT id, (t || list_transform(range({LENGTH}), lambda i: '[PAD]'))[:{LENGTH}] AS padded, list_transform(range({LENGTH}), lambda i: CASE WHEN i < len(t) THEN 1 ELSE 0 END) AS mask
            FROM (SELECT id, string_split(disassembly, ' ') AS t FROM ({fx.TRACES}))""",
    ),
    "vocabulary_ids": (
        vocabulary_ids,
        f"""SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[SEP]', 2), ('[CLS]', 3), ('[MASK]', 4), ('[NEXT]', 5)) s(token, id)
            UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 5 AS INTEGER) FROM ({_TRACE_COUNTS}) WHERE kind = 'tokens' AND token <> '[NEXT]'""",
    ),
    "mlm_mask_deterministic": (mlm_mask_deterministic, _MASKED),
    "collate_batches": (
        collate_batches,
        """SELECT n // 48 AS batch, count(*) AS rows, list(vec_id ORDER BY vec_id) AS ids, list(label ORDER BY vec_id) AS labels,
            list(CAST(floor(embedding[1] * 100) AS INTEGER) ORDER BY vec_id) AS firsts
            FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) GROUP BY 1""",
    ),
    "collate_classification": (
        collate_classification,
        "SELECT list_transform(embedding, lambda x: CAST(floor(x * 100) AS INTEGER)) AS tokens, list_transform(range(64), lambda i: 1) AS mask, label FROM embeddings",
    ),
    "masked_mean_pool": (
        masked_mean_pool,
        f"""SELECT vec_id, {_SUM("list_transform(range(64), lambda i: CASE WHEN i % 4 = vec_id % 4 THEN 0.0::DOUBLE ELSE embedding[i + 1]::DOUBLE END)")} / 48 AS pooled,
            {_SUM("list_transform(embedding, lambda x: x::DOUBLE)")} / 64 AS mean FROM embeddings""",
    ),
    "argmax_position": (argmax_position, "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings"),
    "fill_masked": (
        fill_masked,
        f"SELECT id, list_transform(range({LENGTH}), lambda i: CASE WHEN tokens[i + 1] = 4 THEN CAST(i + 7 AS INTEGER) ELSE tokens[i + 1] END) AS filled FROM ({_MASKED})",
    ),
    "micro_f1": (micro_f1, "SELECT avg(CAST(toxic = quality AS DOUBLE)) AS f1 FROM labels"),
    "cross_entropy": (cross_entropy, "SELECT round(avg(-ln(1.0::DOUBLE - l_discount - l_tax)), 9) AS loss FROM lineitem"),
    "bpe_encode": (bpe_encode, None),
    "bpe_round_trip": (bpe_round_trip, None),
    "probes": (
        probes,
        "SELECT CAST(k AS VARCHAR) AS id, name, disassembly FROM (VALUES " + ", ".join(f"({k}, '{n}', '{p}')" for k, (n, p) in enumerate(pipelines.PROBES)) + ") p(k, name, disassembly)",
    ),
}
