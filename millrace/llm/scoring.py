"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

After Mnih and Hinton (2007) and Mnih and Teh (2012). The context of a token is the sum of
its predecessors' vectors, each scaled by its position; a token's energy is its own
vector times that sum, plus a bias. Training tells tokens from noise drawn from the
unigram distribution; scoring normalises over the whole output layer by batched matrix products.

The output layer has a fixed size, so that neither model nor broadcast grows with the corpus:
the most frequent words, the end of text, and classes of all other words by their last
bytes. A word of a class takes its add-one share of the class's training tokens, so probabilities are
normalised over all words, unseen ones included. Word counts themselves cover the whole training corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage
from .words import keys_of, release, text_blocks, word_spans

#: Single words and word classes of the output layer; with the end of text, 512 outputs.
WORDS, CLASSES = 447, 64
OUTPUTS = 1 + WORDS + CLASSES
#: Predecessors, vector length, noise tokens per batch, tokens per batch of training and of scoring.
CONTEXT, WIDTH, NOISE, BATCH, SCORED = 6, 16, 48, 512, 256
#: Most words whose counts every executor holds; those of the others are joined.
HEAD = 150_000
#: Tokens that a counting task holds before it hands on their counts, and that a scoring task holds.
HELD = 1 << 20
RATE = 0.15
#: Training tokens of a group, which one task learns from.
GROUP = 4_000_000
#: Key of the end of a text. A word's key is 58 bits of hash and the word's class.
END = 0


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token of all texts in a row, A-Z lowered, with ``END`` after each text, and the place after each text.

    The last bits are the word's class, by its last three bytes; different words have equal keys with a chance of about 2**-58.
    """
    raw, starts, ends, stops = word_spans([t.lower() for t in texts])
    last = [np.where(ends - starts >= k, raw[np.maximum(ends - k, 0)], 0).astype(np.uint32) << np.uint32(8 * k - 8) for k in (1, 2, 3)]
    cls = ((last[0] | last[1] | last[2]) * np.uint32(0x9E3779B1)) >> np.uint32(26)
    keys = (keys_of(raw, starts, ends) & ~np.uint64(CLASSES - 1)) | cls.astype(np.uint64)
    keys[keys == END] = CLASSES
    upto = np.searchsorted(starts, stops)
    out = np.full(len(keys) + len(texts), END, dtype=np.uint64)
    out[np.arange(len(keys)) + np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))] = keys
    return out, upto + np.arange(1, len(texts) + 1)


def vocabulary(train: DataFrame) -> DataFrame:
    """``key`` of each token of all rows' ``text``, and ``c``, its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(c)], ["key", "c"])

        for batch in batches:
            for _, texts in text_blocks(batch.column(0)):
                held.append(token_keys(texts)[0])
                if sum(map(len, held)) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
        release()

    return train.select(F.col("text").cast("binary")).mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts that scoring needs everywhere: totals, the head's words, and the output layer's training counts.

    ``tokens`` and ``words`` are those of the training texts, ends included; ``head`` has the keys of the most frequent words, by
    falling count, and ``head_counts`` their counts; words below ``threshold`` are not among them.
    """

    tokens: int
    words: int
    ends: int
    head: np.ndarray
    head_counts: np.ndarray
    threshold: int
    output_counts: np.ndarray
    class_totals: np.ndarray


def lexicon(vocab: DataFrame, head: int = HEAD) -> Lexicon:
    """From the counted vocabulary, a staged table. The driver receives at most ``head`` words and a few hundred sums."""
    words = vocab.filter(F.col("key") != END)
    n, v, ends = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("key") == END, F.col("c"))), F.lit(0))).first()
    # the least count whose words, with all more frequent ones, stay within the bound
    bucket = F.floor(F.log2("c") * 32).cast("int")
    sizes = sorted(((r["b"], r["low"], r["count"]) for r in words.groupBy(bucket.alias("b")).agg(F.min("c").alias("low"), F.count("*").alias("count")).collect()), reverse=True)
    threshold, total = 1 << 62, 0
    for _, low, count in sizes:
        total += count
        if total > head:
            break
        threshold = low
    got = words.filter(F.col("c") >= threshold).toArrow()
    keys, counts = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.lexsort((keys, -counts))
    keys, counts = keys[order], counts[order]
    sums = np.zeros(CLASSES, dtype=np.int64)
    for r in words.groupBy(F.col("key").bitwiseAND(F.lit(CLASSES - 1)).alias("k")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        sums[r["k"]] = r["s"]
    np.subtract.at(sums, (keys[:WORDS] & np.uint64(CLASSES - 1)).astype(int), counts[:WORDS] + 1)
    outputs = np.concatenate([[ends], counts[:WORDS], np.zeros(WORDS - len(counts[:WORDS]), dtype=np.int64), sums])
    return Lexicon(int(n), int(v), int(ends), keys, counts, threshold, outputs, sums)


class Places:
    """Place of each key in an array of different keys, -1 for others: a hash table by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.steps = np.uint64(64 - bits), (1 << bits) - 1, 1
        self.keys, self.at = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            own = (slot[left] + self.steps - 1) & self.mask
            free = np.nonzero(self.at[own] < 0)[0]
            taken, first = np.unique(own[free], return_index=True)
            self.at[taken], self.keys[taken] = left[free[first]], keys[left[free[first]]]
            left = np.delete(left, free[first])
            self.steps += 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        at, same = self.at[slot], self.keys[slot] == keys
        out = np.where(same & (at >= 0), at, -1)
        left = np.nonzero(~same & (at >= 0))[0]  # an empty slot ends the search
        for step in range(1, self.steps):
            if not len(left):
                break
            own = (slot[left] + step) & self.mask
            at, same = self.at[own], self.keys[own] == keys[left]
            out[left[same & (at >= 0)]] = at[same & (at >= 0)]
            left = left[~same & (at >= 0)]
        return out


class Model:
    """Parameters as one float32 vector with named views."""

    SHAPES = (("context", (OUTPUTS, WIDTH)), ("target", (OUTPUTS, WIDTH)), ("place", (CONTEXT, WIDTH)), ("bias", (OUTPUTS,)))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(sum(math.prod(s) for _, s in cls.SHAPES), dtype=np.float32))

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 5) -> Model:
        """The unigram model, with small random context vectors."""
        out, rng = cls.empty(), np.random.default_rng(seed)
        out.context[:] = rng.normal(0, 0.3, out.context.shape)
        out.target[:] = rng.normal(0, 0.05, out.target.shape)
        out.place[:] = 1.0 / np.sqrt(np.arange(1, CONTEXT + 1))[:, None]
        out.bias[:] = np.log(unigram)
        return out


def contexts(ids: np.ndarray) -> np.ndarray:
    """Predecessors of each token, nearest first (CONTEXT x tokens); before a text stands its end.

    ``ids`` holds whole texts in a row, each with its end (0) last. Looking back
    stops at an end: what lies before one belongs to another text.
    """
    out = np.zeros((CONTEXT, len(ids)), dtype=np.int32)
    alive = np.ones(len(ids), dtype=bool)
    for k in range(1, CONTEXT + 1):
        out[k - 1, k:] = ids[:-k]
        alive &= out[k - 1] != 0
        out[k - 1, ~alive] = 0
    return out


def unigram(counts: np.ndarray) -> np.ndarray:
    return ((counts + 1) / (counts + 1).sum()).astype(np.float64)


class Trainer:
    """Adagrad on the noise-contrastive loss, with noise that a batch shares."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.q, self.rng = model, noise, np.random.default_rng(seed)
        self.cum, self.log_kq = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.sq, self.grad = Model(np.full_like(model.flat, 1e-6)), Model.empty()

    @staticmethod
    def _scatter(into: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        flat = (ids.astype(np.int64)[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        into += np.bincount(flat, weights=rows.ravel(), minlength=into.size).reshape(into.shape).astype(np.float32)

    def step(self, ids: np.ndarray, before: np.ndarray) -> None:
        m, g, n = self.m, self.grad, len(ids)
        g.flat[:] = 0
        vectors = m.context[before]
        h = (vectors * m.place[:, None]).sum(axis=0)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), OUTPUTS - 1)
        pos = np.einsum("nw,nw->n", h, m.target[ids]) + m.bias[ids] - self.log_kq[ids]
        neg = h @ m.target[noise].T + (m.bias[noise] - self.log_kq[noise])
        # derivative of the loss by each score, over the batch's mean
        dp = ((1 / (1 + np.exp(-pos)) - 1) / n).astype(np.float32)
        dn = (1 / (1 + np.exp(-neg)) / n).astype(np.float32)
        dh = dp[:, None] * m.target[ids] + dn @ m.target[noise]
        self._scatter(g.target, ids, dp[:, None] * h)
        np.add.at(g.target, noise, dn.T @ h)
        g.bias += np.bincount(ids, weights=dp, minlength=OUTPUTS).astype(np.float32)
        np.add.at(g.bias, noise, dn.sum(0))
        self._scatter(g.context, before.ravel(), (dh[None] * m.place[:, None]).reshape(-1, WIDTH))
        g.place += (vectors * dh).sum(axis=1)
        self.sq.flat += g.flat**2
        m.flat -= RATE * g.flat / np.sqrt(self.sq.flat)


def encoded(docs: DataFrame, is_train: Column, lex: Lexicon) -> DataFrame:
    """Each row of ``docs`` in tokens: ``doc_id, train, n_tokens, known, base, inner, ids, tail``.

    ``ids`` holds the output of each token in two bytes, ``base`` the summed log10(c + 1) of tokens in the head, and ``inner``
    what words of a class have as their share of it; ``tail`` are the keys of the words outside the head, whose counts are joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lex.head, lex.head_counts, lex.class_totals))
    ends = lex.ends

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, totals = shared.value
        places, log_counts = Places(head), np.log10(np.append(counts, [0, ends]) + 1.0)  # the last two: outside the head, and the end
        minus = np.concatenate([np.zeros(1 + WORDS), np.log10(totals + 1.0)])
        for batch in batches:
            for first, texts in text_blocks(batch.column(2)):
                keys, stops = token_keys(texts)
                at, is_end, starts = places(keys), keys == END, np.append(0, stops[:-1])
                ids = np.where((at >= 0) & (at < WORDS), 1 + at, (1 + WORDS + (keys & np.uint64(CLASSES - 1))).astype(np.int64))
                ids[is_end] = 0
                own = log_counts[np.where(is_end, len(counts) + 1, np.where(at < 0, len(counts), at))]
                outside = np.nonzero((at < 0) & ~is_end)[0]
                inner = np.where(ids > WORDS, own, 0.0) - minus[ids]
                sums = [np.add.reduceat(x, starts) for x in (((at >= 0) | (is_end & (ends > 0))).astype(np.int64), own, inner)]
                offsets = np.append(0, 2 * stops).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                tail = pa.ListArray.from_arrays(np.append(0, np.searchsorted(outside, stops)).astype(np.int32), pa.array(keys[outside].view(np.int64)))
                part = batch.slice(first, len(texts))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(stops - starts), *map(pa.array, sums), raw, tail], ["doc_id", "train", "n_tokens", "known", "base", "inner", "ids", "tail"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(each, "doc_id long, train boolean, n_tokens long, known long, base double, inner double, ids binary, tail array<long>")


def fit(rows: DataFrame, lex: Lexicon, parts: int = 8, seed: int = 11) -> Model:
    """Pass once over the training rows of :func:`encoded`, in two rounds of parameter mixing (McDonald, Hall and Mann, 2010).

    Rows are dealt by a hash of doc_id and tokens to groups of about ``GROUP`` tokens and sorted by it, so what is learned does not depend
    on how they were partitioned. In a round every group is learned from the same parameters, and the results are averaged
    by their numbers of tokens. Round one takes one row in ``parts``, round two the others.
    A group hands on one number per parameter, so the sums are as large as the model whatever the corpus.
    """
    noise = unigram(lex.output_counts)
    model, sc = Model.start(noise), rows.sparkSession.sparkContext
    chosen = rows.filter("train").select(F.xxhash64("doc_id", "ids").alias("h"), "ids")
    first = F.pmod(F.shiftright("h", 20), F.lit(parts)) == 0

    def learner(start: Broadcast, seed: int) -> Callable[[pa.Table], pa.Table]:
        def learn(table: pa.Table) -> pa.Table:
            trainer, seen = Trainer(Model(start.value.copy()), noise, seed), 0
            order = np.argsort(table.column("h").to_numpy(), kind="stable")
            raw = table.column("ids").combine_chunks()
            for at in range(0, len(order), 2048):
                ids = np.frombuffer(b"".join(raw.take(pa.array(order[at : at + 2048])).to_pylist()), "<u2").astype(np.int32)
                before = contexts(ids)
                for lo in range(0, len(ids), BATCH):
                    trainer.step(ids[lo : lo + BATCH], before[:, lo : lo + BATCH])
                seen += len(ids)
            flat = trainer.m.flat.astype(np.float64) * seen
            return pa.table({"at": pa.array(np.arange(len(flat) + 1), pa.int32()), "x": pa.array(np.append(flat, seen), pa.float64())})

        return learn

    for k, (some, tokens) in enumerate(((chosen.filter(first), lex.tokens // parts), (chosen.filter(~first), lex.tokens))):
        learn = learner(sc.broadcast(model.flat), seed + k)
        groups = max(1, -(-tokens // GROUP))
        learned = some.groupBy(F.pmod("h", F.lit(groups)).alias("grp")).applyInArrow(learn, "at int, x double")
        sums = learned.groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")["x"].to_numpy()
        if len(sums) and sums[-1] > 0:
            model = Model((sums[:-1] / sums[-1]).astype(np.float32))
    return model


def log_probabilities(model: Model, ids: np.ndarray) -> np.ndarray:
    """Natural logarithm of the normalised probability of each token given its predecessors."""
    before, out = contexts(ids), np.empty(len(ids))
    tables = model.place[:, None, :] * model.context[None]
    # the bias is one more dimension, so that a single product gives all energies of a batch
    target = np.ascontiguousarray(np.vstack([model.target.T, model.bias]))
    ones, longest, most = np.ones(OUTPUTS, dtype=np.float32), float(np.linalg.norm(model.target, axis=1).max()), float(np.abs(model.bias).max())
    h = np.ones((SCORED, WIDTH + 1), dtype=np.float32)
    for at in range(0, len(ids), SCORED):
        own = ids[at : at + SCORED]
        x = h[: len(own)]
        v = x[:, :WIDTH]
        v[:] = tables[0][before[0, at : at + SCORED]]
        for k in range(1, CONTEXT):
            v += tables[k][before[k, at : at + SCORED]]
        energy = x @ target
        if float(np.sqrt((v * v).sum(axis=1).max())) * longest + most > 80:  # exp would leave its range
            energy -= energy.max(axis=1, keepdims=True)
        own_energy = energy[np.arange(len(own)), own]
        np.exp(energy, out=energy)
        out[at : at + SCORED] = own_energy - np.log(energy @ ones)
    return out


def score(rows: DataFrame, vocab: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row of :func:`encoded`, a staged table with a ``row`` that numbers it.

    The model's score is made where the row's ids are read and stays beside them. Only the rare words leave the row, to be counted, and come
    back by the number that the table holds, so it does not matter how scans of it are dealt out.
    """
    flat, base_norm = rows.sparkSession.sparkContext.broadcast(model.flat), math.log10(lex.tokens + lex.words + 1)
    through = ["row", "doc_id", "train", "n_tokens", "known", "base", "inner"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = Model(flat.value)
        for batch in batches:
            for at, raw in text_blocks(batch.column(len(through)), 2 * HELD):
                lengths = np.array([len(x) // 2 for x in raw])
                lp = log_probabilities(lm, np.frombuffer(b"".join(raw), "<u2").astype(np.int32))
                lp = np.add.reduceat(lp, np.cumsum(lengths) - lengths) / math.log(10)
                yield pa.record_batch([*batch.slice(at, len(raw)).columns[: len(through)], pa.array(lp)], [*through, "lm"])
        release()

    modelled = rows.select(*through, "ids").mapInArrow(each, "row long, doc_id long, train boolean, n_tokens long, known long, base double, inner double, lm double")
    # counts of the words outside the head: unseen ones add nothing, so an inner join does
    tail = rows.select("row", F.explode("tail").alias("key"))
    rare = vocab.filter((F.col("c") < lex.threshold) & (F.col("key") != END))
    more = tail.join(rare, "key").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    extra = F.coalesce("more", F.lit(0.0))
    return modelled.join(more, "row", "left").select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("lm") + F.col("inner") + extra).alias("score"),
    )


def train_and_score(docs: DataFrame, is_train: Column, head: int = HEAD) -> DataFrame:
    """Learn counts and model from the rows of ``docs`` (``doc_id, text``) where ``is_train`` holds, and score all of them.

    Texts are read twice: to count words, and to turn them into tokens, which are staged and serve both learning and scoring.
    Null text is empty: its one token is the end. Repeated rows are scored alike. Whole texts count, however long. With nothing to
    train on, all words are unseen and outputs are equally likely. Empty tables give empty results; extra columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        vocab = stage(vocabulary(docs.filter(is_train)), "lm-vocabulary")
        lex = lexicon(vocab, head)
        rows = stage(encoded(docs, is_train, lex).withColumn("row", F.monotonically_increasing_id()), "lm-rows")  # the number is data from here on
        kept.append(stage(score(rows, vocab, lex, fit(rows, lex)), "lm-scores"))
    return kept[0]
