"""Quality rules: a decision list learned by sequential covering.

Documents become a dozen statistics. From labelled documents a list of rules, each a
conjunction of thresholds, is grown and pruned (Fuernkranz and Widmer, 1994; Cohen, 1995):
a rule is grown on one part of the rows until it covers no good document there, its last
conditions are cut while that helps on the other part, and it is kept if it is precise there; then the
rows it covers are set aside. The list is emitted as one ordered Spark ``CASE`` expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .words import release, text_blocks, windows, word_keys

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_upper", "n_letters", "n_end_marks", "n_bar_words", "n_distinct", "n_lines", "n_same_next")
#: Statistics that rules may test; all are ratios, so that a rule does not depend on length, but for the first.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "letters": "n_letters / greatest(word_chars, 1)",
    "marks_per_word": "n_end_marks / greatest(n_words, 1)",
    "bars_per_word": "n_bar_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "same_next": "n_same_next / greatest(n_words, 1)",
}
_SYMBOLS, _NOT_START = b"#*$%&|<>", bytes(range(0x80, 0xC0))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))


def _others(kept: bytes) -> bytes:
    return bytes(set(range(256)) - set(kept))


_NOT_SYMBOLS, _NOT_UPPER, _NOT_LETTERS, _NOT_MARKS = map(_others, (_SYMBOLS, _UPPER, _LETTERS, b"!?"))


def _count(raw: bytes, drop: bytes) -> int:
    return len(raw.translate(None, drop))


def text_counts(raw: bytes, h: np.ndarray | None = None) -> tuple[int, ...]:
    """``COUNTS`` of one text in UTF-8; ``h`` has the keys of its words, if they are known.

    ``n_repeat_words`` are the words that lie in some 5-word window whose five words
    occur, as a window, at least twice in the text. ASCII capitals only count as upper case;
    a letter is an ASCII letter or the lead byte of a longer character.
    """
    words = raw.split()
    h = word_keys([raw])[0] if h is None else h
    repeat = 0
    if len(h) > 5:
        w = windows(h)
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(w), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            edge = np.zeros(len(h) + 1, dtype=np.int64)
            at = np.nonzero(twice)[0]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        _count(raw, _NOT_START + b" \t\n\x0b\x0c\r"),
        _count(raw, _NOT_SYMBOLS),
        len(lines) - len(set(lines)),
        repeat,
        _count(raw, _NOT_UPPER),
        _count(raw, _NOT_LETTERS),
        _count(raw, _NOT_MARKS),
        words.count(b"|"),
        len(set(words)),
        len(lines),
        int((h[1:] == h[:-1]).sum()),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts ``COUNTS`` of every whole text; null text has none of anything. Columns of those names are replaced."""
    docs = docs.drop(*COUNTS)
    at = docs.columns.index("text")
    names = [*docs.columns, *COUNTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(at)):
                keys, ends = word_keys(texts)
                rows = [text_counts(x, keys[lo:hi]) for x, lo, hi in zip(texts, np.append(0, ends), ends, strict=False)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, *(pa.array(x, pa.int64()) for x in columns)], names=names)
        release()

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every text."""
    return with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).drop("text")


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds (statistic, at least or at most, value), and what it covered while learning."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    bad: int

    def expression(self) -> Column:
        out = F.lit(True)
        for name, side, value in self.conditions:
            x = F.expr(FEATURES[name])
            out = out & (x >= F.lit(value) if side == ">=" else x <= F.lit(value))
        return out

    def covers(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(rows), dtype=bool)
        for name, side, value in self.conditions:
            out &= (rows[name] >= value).to_numpy() if side == ">=" else (rows[name] <= value).to_numpy()
        return out


def _grow(x: pd.DataFrame, y: np.ndarray, deepest: int) -> list[tuple[str, str, float]]:
    """Add the condition with the largest information gain until no good row is covered; of equal gains that with the widest gap at its cut, by the range of values."""
    chosen: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(chosen) < deepest and (~y[inside]).any() and y[inside].any():
        p0, n0 = y[inside].sum(), inside.sum()
        best = (0.0, 0.0, None)
        for name in x.columns:
            v = x[name].to_numpy()[inside]
            order = np.argsort(v, kind="stable")
            sv, sy = v[order], y[inside][order]
            ends = np.nonzero(np.append(sv[1:] != sv[:-1], False))[0]  # a cut lies between two different values
            if not len(ends):
                continue
            below_p, below_n = np.cumsum(sy)[ends], ends + 1
            middle = (sv[ends] + sv[ends + 1]) / 2
            for side, p, n in (("<=", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), -1.0)
                k = int(np.argmax(gain))
                gap = float(sv[ends[k] + 1] - sv[ends[k]]) / float(sv[-1] - sv[0])
                if gain[k] > best[0] + 1e-9 or gain[k] > max(best[0] - 1e-9, 1e-9) and gap > best[1]:
                    best = (max(best[0], float(gain[k])), gap, (name, side, float(middle[k])))
        if best[2] is None:
            break
        chosen.append(best[2])
        inside &= Rule((best[2],), 0, 0).covers(x)
    return chosen


def learn(rows: pd.DataFrame, precision: float = 0.9, least: int = 5, deepest: int = 4, most_rules: int = 24, seed: int = 7) -> list[Rule]:
    """Rules for bad documents from ``rows`` (columns of ``FEATURES`` and boolean ``bad``).

    Two thirds of the rows grow a rule and one third prunes it. A rule is kept if it covers
    ``least`` rows in all and is at least ``precision`` bad on either part; learning ends at the first that is not.
    """
    rules: list[Rule] = []
    rows = rows.sample(frac=1, random_state=seed).reset_index(drop=True)
    features = [c for c in rows.columns if c in FEATURES]
    part = np.arange(len(rows)) % 3 == 2
    while len(rules) < most_rules and rows["bad"].any():
        y = rows["bad"].to_numpy(dtype=bool)
        conditions = _grow(rows.loc[~part, features], y[~part], deepest)
        held, hy = rows.loc[part], y[part]

        def worth(some: list[tuple[str, str, float]]) -> float:
            c = Rule(tuple(some), 0, 0).covers(held)  # noqa: B023
            return (hy[c].sum() - (~hy[c]).sum()) / max(1, c.sum())  # noqa: B023

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        if not conditions:
            break
        covered = Rule(tuple(conditions), 0, 0).covers(rows)
        rule = Rule(tuple(conditions), int(covered.sum()), int(y[covered].sum()))
        right = [y[covered & side].mean() if (covered & side).any() else 1.0 for side in (part, ~part)]
        if rule.covered < least or min(right) < precision:
            break
        rules.append(rule)
        rows, part = rows[~covered].reset_index(drop=True), part[~covered]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a document, 0 if none does: one ordered ``CASE``."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.expression(), k) if out is None else out.when(rule.expression(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000) -> pd.DataFrame:
    """At most ``sample_rows`` labelled documents' features and ``bad`` (quality 0), chosen by a hash of their id.

    An id is one row of it: of several rows with one id the least counts stand for all, found in each task first, so neither the
    driver nor what is learned depends on how often an id repeats.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, sample_rows / max(1, known.count()))
    # the hash leaves about as many as asked for, the limit no more
    known = stage(known.filter(place < F.lit(int(share * (1 << 40)))).orderBy(place, "doc_id").limit(sample_rows), "quality-labels")
    # the sample is bounded, so it goes to the documents and no text is shuffled
    rows = statistics(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("least")).select("doc_id", "least.*").join(F.broadcast(known), "doc_id")
    return one.select(*[F.expr(x).alias(n) for n, x in FEATURES.items()], (F.col("quality") == 0).alias("bad")).orderBy("doc_id").toPandas()


def with_verdict(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counted documents with ``base_failed``, ``rule`` (the first that covers them, 0: none) and ``kept``."""
    rows = counted.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000) -> DataFrame:
    """Learn from the labelled documents and judge all of them.

    Null text counts as no words, so it fails the base rule. Repeated rows are judged alike.
    Labels without a document, or null, teach nothing; of several labels of one document the
    lowest holds, and several rows of one doc_id teach as one. Without labels there are no rules and the base rule alone decides.
    Texts are counted whole, however long. An empty table gives an empty result; extra columns are ignored.
    """
    return with_verdict(statistics(docs), learn(labelled_sample(docs, labels, sample_rows)))
