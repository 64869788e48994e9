"""Documents with every odd case, shared by the tests of this folder."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    common = {"en": "the of and to in".split(), "de": "der die und zu von".split()}[lang]
    parts = {"en": "th in er an on ea st".split(), "de": "sch ein ung ver ich keit".split()}[lang]
    out = [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(words)]
    return " ".join(out)


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(20, 200), "en" if k % 3 else "de"), "en" if k % 3 else "de", f"s{k % 4}", 0) for k in range(60)]
    long = prose(rng, 30_000)
    rows += [
        (60, None, "en", "s0", None),
        (61, "", None, "s0", 0),
        (62, " \n\t ", "en", None, 4),
        (63, "1234 !!! ### 42", "en", None, 3),
        (64, long, "en", "s1", len(long)),
        (65, rows[5][1], "en", "s1", 0),
        (66, rows[5][1], None, "s2", 0),
        (66, rows[5][1], None, "s2", 0),
        (67, rows[7][1] + " extra", "en", None, 0),
        (68, "word", "en", "s3", 4),
        (69, "İstanbul ΣΑΣ 日本語 ñandú ́x \x0b\x1c z", None, "s3", 0),
        (70, "the the the the", "en", "s3", 0),
    ]
    rows += [(100 + k, "same text again and again " * 10, "en", "hot", 0) for k in range(40)]
    rows += [(None, "no id here at all, and nothing more to say", "en", "s0", 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """All odd cases in several partitions."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with further columns that have the names operators use inside."""
    from pyspark.sql import functions as F

    names = "lang_pred score langs size h sid copies budget rest node rep comp component sig digest range key rng w grp piece start n_words kept rule bad row words times next_text sigs".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
