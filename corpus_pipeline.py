"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, minhash, mixing, packing, quality
from millrace.llm.common import aside, drop_stage, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language, as learned from all that carry a label.

    Rejected are those without a letter, and those whose letters fit the best mixture of the learned languages
    worse than no language at all; text in several languages is as good as any. Null text goes, as do
    empty texts; without any label nothing is recognised. Equal rows share a fate, and every column comes back as it was.
    """
    langs, model = langid.train(docs)
    rows, back = aside(docs, "text")
    return back(langid.annotate(rows, langs, model).filter("lang_pred <> 'und' and fit > 0"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that neither the base rule nor a learned rule rejects.

    Null and empty texts have no words and go. Rows that repeat a doc_id share its label and are judged each by its text;
    without labels the base rule alone decides. Every column comes back as it was.
    """
    rules = quality.learn(quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    rows, back = aside(docs, "text")
    return back(quality.with_verdict(quality.with_statistics(rows), rules).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that with the smallest doc_id, and all rows that are in none.

    Rows are told apart by doc_id and text: :func:`millrace.llm.minhash.one_of_each` says what becomes of repeats and nulls.
    """
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target; a document that is taken more than once stands there as often.

    Null sources are one source. Null texts have no words, and stand there as often as their whole source does.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise, cut and pack what is left: one row per piece. Null text is one id, the end."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned models, MinHash and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES, 1):
        done, docs = docs, stage(function(spark, docs, sf_dir), f"pipeline-{k}")
        if k > 1:
            drop_stage(done)
    return docs
