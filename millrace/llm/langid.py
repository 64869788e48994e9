"""Language identification by multilingual mixture inference.

A language is a distribution over letter trigrams. A document is a mixture: each of its words
comes from one language, with the document's own proportions (after Lui, Lau and
Baldwin, 2014). Expectation-maximisation estimates the proportions from the words' trigram
likelihoods; the set of languages grows one at a time for as long as the gain in
log-likelihood exceeds a penalty for the further parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import release, text_blocks

#: Trigrams are hashed into this many buckets, so a model's size does not depend on the corpus.
BUCKETS = 1 << 16
#: Code points that are held as arrays at once.
BLOCK = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter of all texts in a row, where each word starts, and each word's text.

    Letters are lower-cased; all else parts words and counts as one blank in a trigram.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    a = np.where(_is_letter()[codes], codes, np.uint32(0))
    mid = np.nonzero(a)[0]
    h = a[mid - 1] * np.uint32(0x9E3779B1) + a[mid] * np.uint32(0x85EBCA6B) + a[mid + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    buckets = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.nonzero(np.diff(mid, prepend=-2) > 1)[0]
    ends = np.cumsum([len(t) + 1 for t in lowered])  # text k lies before ends[k] + 1
    return buckets, starts, np.searchsorted(ends, mid[starts], "right") if len(starts) else starts


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BLOCK`` code points."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def train(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of each bucket, from ``text, lang`` of every given row.

    Counts are summed where they are read: a task hands on one row per language and bucket.
    Null texts or languages teach nothing. The driver receives languages times ``BUCKETS`` sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, texts in text_blocks(batch.column(0), BLOCK, raw=False):
                buckets, starts, owner = trigrams(texts)
                if not len(starts):
                    continue
                names, ids = np.unique(np.array(batch.column(1).slice(at, len(texts)).to_pylist(), dtype=object), return_inverse=True)
                of = np.repeat(ids[owner], np.diff(starts, append=len(buckets)))
                found = np.bincount(of * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, found, strict=True):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.nonzero(row)[0]
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])

    rows = (
        labelled.filter("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    counts = np.full((len(langs), BUCKETS), smoothing)
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=int), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T.copy()


def _em(ratio: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Share of a further language in each document, and the gain in log-likelihood.

    ``ratio`` is, per word, its likelihood under the further language over that under the mixture so far.
    """
    share = np.full(len(starts), 0.5, dtype=np.float32)
    for _ in range(steps):
        part = np.repeat(share, lengths)
        weighed = part * ratio
        share = np.add.reduceat(weighed / (1 - part + weighed), starts) / lengths
    part = np.repeat(share, lengths)
    return share, np.add.reduceat(np.log1p(part * (ratio - 1)), starts)


def infer(texts: list[str], table: np.ndarray, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportion of each language in each text, and the mean log-likelihood of its letters' trigrams (zeros where a text has no letters).

    Languages outside the selected set have none. The set starts with the best single
    language; a further one enters if it gains more than ``penalty * ln(words + 1)``, the best first.
    """
    n_langs = table.shape[1]
    out, fit = np.zeros((len(texts), n_langs), dtype=np.float64), np.zeros(len(texts))
    if not n_langs:
        return out, fit
    for lo, hi in _blocks(texts):
        buckets, word_at, owner = trigrams(texts[lo:hi])
        if not len(word_at):
            continue
        ll = np.add.reduceat(table[buckets], word_at, axis=0)
        docs, starts, lengths = np.unique(owner, return_index=True, return_counts=True)
        best = np.argmax(np.add.reduceat(ll, starts, axis=0), axis=1)
        share = np.zeros((len(docs), n_langs))
        share[np.arange(len(docs)), best] = 1.0
        now = ll[np.arange(len(ll)), np.repeat(best, lengths)]
        live = np.arange(len(docs))
        total, letters = np.add.reduceat(now, starts, dtype=np.float64), np.add.reduceat(np.diff(word_at, append=len(buckets)), starts)
        for _ in range(n_langs - 1):
            bar = penalty * np.log(lengths + 1.0)
            best_gain, best_share, best_lang = np.zeros(len(live)), np.zeros(len(live)), np.zeros(len(live), dtype=int)
            for lang in range(n_langs):
                over = np.clip(ll[:, lang] - now, -30, 30)
                # no share can gain more than every word's better side: most languages end here
                room = (np.add.reduceat(np.maximum(over, 0), starts) > bar) & (share[live, lang] == 0)
                if not room.any():
                    continue
                rows = np.repeat(room, lengths)
                own = lengths[room]
                part, gain = _em(np.exp(over[rows]), np.append(0, np.cumsum(own)[:-1]), own)
                at = np.nonzero(room)[0]
                better = gain > np.maximum(best_gain[at], bar[at])
                best_gain[at[better]], best_share[at[better]], best_lang[at[better]] = gain[better], part[better], lang
            grown = best_gain > 0
            if not grown.any():
                break
            rows = np.repeat(grown, lengths)
            ll, live, lengths = ll[rows], live[grown], lengths[grown]
            starts = np.append(0, np.cumsum(lengths)[:-1])
            part = best_share[grown]
            share[live] *= 1 - part[:, None]
            share[live, best_lang[grown]] = part
            # a few joint steps over the whole set, then the mixture's likelihood of each word
            top = ll.max(axis=1, keepdims=True)
            p = np.exp(ll - top)
            for _ in range(4):
                mixed = p * np.repeat(share[live], lengths, axis=0)
                share[live] = np.add.reduceat(mixed / mixed.sum(1, keepdims=True), starts, axis=0) / lengths[:, None]
            now = np.log((p * np.repeat(share[live], lengths, axis=0)).sum(1)).astype(np.float32) + top[:, 0]
            total[live] = np.add.reduceat(now, starts, dtype=np.float64)
        out[lo + docs], fit[lo + docs] = share, total / letters
    return out, fit


def annotate(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 2.0) -> DataFrame:
    """``docs`` with ``lang_pred, score, langs, fit``: the largest language, its share, all of the set with theirs, and how well they fit.

    ``fit`` is the mean log-likelihood of a letter's trigram under the mixture, less that under no
    language at all, where all trigrams are alike. Text of a language that was never learned, or of letters at random, is below 0.

    Null text, or text without a letter, is ``und`` with score 0 and no languages; so is all text if
    nothing was learned. Ties go to the language that sorts first. Empty tables give empty results. Columns
    of ``docs`` with the new names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(table)
    docs = docs.drop("lang_pred", "score", "langs", "fit")
    at = docs.columns.index("text")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.StringType()), T.StructField("fit", T.DoubleType())]
    names = [*docs.columns, *(f.name for f in fields)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(at), BLOCK, raw=False):
                share, fit = infer(texts, model.value, penalty)
                top = share.argmax(1) if len(langs) else np.zeros(len(share), dtype=int)
                score = share.max(1) if len(langs) else np.zeros(len(share))
                best = [langs[k] if s > 0 else "und" for k, s in zip(top, score, strict=True)]
                sets = [" ".join(f"{langs[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) for row in share]
                fit = np.where(score > 0, fit + np.log(BUCKETS), 0.0)
                new = [pa.array(best, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64()), pa.array(sets, pa.string()), pa.array(fit)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, *new], names=names)
        release()

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, *fields]))


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 2.0) -> DataFrame:
    """``doc_id, lang_pred, score, langs, fit`` of every row of ``docs``, as :func:`annotate` gives them."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, table, penalty).drop("text")
