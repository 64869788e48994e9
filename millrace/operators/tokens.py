"""Token counts, vocabularies and the tokenizer's encoding.

Disassembly is text: tokens parted by white space, ``[NEXT]`` between instructions. Integers are
immediates and are cut by byte-pair encoding (Sennrich, Haddow and Birch, 2016); all other tokens are whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import DisassembledFunctionDataset, validate
from ..sources.shared import staged
from .frame import number

PREFIX = "__"


def count_tokens(df: DataFrame, column: str = "disassembly") -> DataFrame:
    """``kind`` (``tokens`` or ``immediates``), ``token`` and ``n`` over all rows; combined before the shuffle."""
    t = df.select(F.explode(text.tokens(F.col(column))).alias("token"))
    kind = F.when(text.is_immediate(F.col("token")), "immediates").otherwise("tokens")
    return t.groupBy(kind.alias("kind"), "token").agg(F.count("*").alias("n"))


def preprocess_tokens(df: DataFrame) -> DataFrame:
    return count_tokens(validate(df, DisassembledFunctionDataset))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum of several tables of counts."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("kind", "token").agg(F.sum("n").alias("n"))


def counts_json(counts: DataFrame) -> DataFrame:
    """One row ``value`` with ``{"tokens": {..}, "immediates": {..}}``; for vocabularies that fit one value."""
    pairs = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("token", "n")))))
    return counts.agg(F.to_json(F.struct(pairs("tokens").alias("tokens"), pairs("immediates").alias("immediates"))).alias("value"))


def unique_tokens(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("unique_tokens"))


def vocabulary_ids(counts: DataFrame, first: int = len(text.SPECIAL_TOKENS)) -> DataFrame:
    """``token, id`` of whole tokens, the most frequent first, ties by token, after the special ones.

    A vocabulary is small next to the corpus it counts; it is ranked by ranges, so its size is no one task's.
    """
    special = counts.sparkSession.createDataFrame(list(zip(text.SPECIAL_TOKENS, range(first), strict=False)), "token string, id int")
    others = counts.filter("kind = 'tokens'").filter(~F.col("token").isin(*text.SPECIAL_TOKENS))
    ranked = number(others.select("token", "n"), "id", F.col("n").desc(), "token")
    return special.union(ranked.select("token", (F.col("id") + first).cast("int").alias("id")))


@dataclass
class Tokenizer:
    """Ids of special tokens, byte-pair pieces and whole tokens, and how immediates are merged."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    whole: list[str]
    length: int = 512
    _ranks: dict[tuple[str, str], int] = field(default_factory=dict, repr=False)
    _seen: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._ranks = {m: k for k, m in enumerate(self.merges)}
        added = sorted({*text.SPECIAL_TOKENS, *self.whole}, key=lambda t: (-len(t), t))
        self._added = re.compile("|".join(map(re.escape, added)))
        self._names = {v: k for k, v in self.ids.items()}

    def pieces(self, word: str) -> list[int]:
        """Ids of one immediate: pieces merged in the order learned, ``[UNK]`` for each unknown one."""
        if word not in self._seen:
            parts = [c if k == 0 else PREFIX + c for k, c in enumerate(word)]
            while len(parts) > 1:
                rank, at = min((self._ranks.get(pair, len(self._ranks)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == len(self._ranks):
                    break
                pair = (parts[at], parts[at + 1])
                merged, k = [], 0
                while k < len(parts):
                    if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                        merged.append(parts[k] + parts[k + 1].removeprefix(PREFIX))
                        k += 2
                    else:
                        merged.append(parts[k])
                        k += 1
                parts = merged
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[word] = [self.ids.get(p, text.UNK) for p in parts]
        return self._seen[word]

    def pieces_of(self, words: list[str]) -> list[list[int]]:
        """:meth:`pieces` of many words: in each round every word merges its first pair by rank, all of them at once in arrays."""
        names = {p: k for k, p in enumerate({p for pair in self.merges for p in (*pair, pair[0] + pair[1].removeprefix(PREFIX))})}
        for w in words:
            for k, c in enumerate(w):
                names.setdefault(c if k == 0 else PREFIX + c, len(names))
        order = sorted((names[x] << 32 | names[y], rank, names[x + y.removeprefix(PREFIX)]) for (x, y), rank in self._ranks.items())
        keys, ranks, made = (np.array(v, np.int64) for v in zip(*order, strict=True)) if order else (np.zeros(0, np.int64),) * 3
        flat = np.array([names[c if k == 0 else PREFIX + c] for w in words for k, c in enumerate(w)], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = np.int64(len(self._ranks))
        while len(keys) and len(flat) > 1:
            pair = flat[:-1] << 32 | flat[1:]
            found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.where((keys[found] == pair) & (word[:-1] == word[1:]), ranks[found], none)
            least = np.full(len(words), none)
            np.minimum.at(least, word[:-1], rank)
            at = np.flatnonzero((rank < none) & (rank == least[word[:-1]]))
            if not len(at):
                break
            first = np.r_[True, np.diff(at) != 1]  # of pairs that overlap every second
            start = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - start[np.cumsum(first) - 1]) % 2 == 0]
            flat[at] = made[found[at]]
            flat, word = np.delete(flat, at + 1), np.delete(word, at + 1)
        known = np.array([self.ids.get(p, text.UNK) for p in names], np.int64)
        out, ends = known[flat].tolist() if len(flat) else [], np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_batch(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode` of a column: ids and masks, a row of the fixed length for each value; null is empty.

        Neither whole tokens nor words hold white space, so what lies between it is encoded by itself, each distinct one once.
        """
        parts = pc.split_pattern_regex(pc.fill_null(values.cast(pa.large_string()), ""), r"[ \t\n\r\f\v]+")
        row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        distinct = parts.flatten().dictionary_encode()
        chunks, code = distinct.dictionary.to_pylist(), distinct.indices.to_numpy(zero_copy_only=False)
        unseen = list(dict.fromkeys(w for c in chunks if not self._added.fullmatch(c) for w in re.findall(r"\w+|[^\w\s]+", self._added.sub(" ", c)) if w not in self._seen))
        if len(self._seen) + len(unseen) > 100_000:
            self._seen.clear()
            unseen = list(dict.fromkeys(w for c in chunks for w in re.findall(r"\w+|[^\w\s]+", self._added.sub(" ", c))))
        self._seen.update(zip(unseen, self.pieces_of(unseen), strict=True))
        coded = [self.encode_all(c) for c in chunks]
        size = np.array([len(c) for c in coded], np.int64)
        start, pool = np.cumsum(size) - size, np.array([i for c in coded for i in c], np.int32)
        n = size[code]
        before = np.cumsum(n) - n  # ids before each part, in the column and then in its row
        first = np.searchsorted(row, np.arange(len(parts)))
        in_row = before - (before[first[row]] if len(row) else 0)
        at = np.repeat(in_row - before, n) + np.arange(n.sum())
        kept = at < self.length
        ids, mask = np.full((len(parts), self.length), text.PAD, np.int32), np.zeros((len(parts), self.length), np.int32)
        place = (np.repeat(row, n)[kept], at[kept])
        ids[place], mask[place] = pool[(np.repeat(start[code] - before, n) + np.arange(n.sum()))[kept]], 1
        return ids, mask

    def encode_all(self, value: str) -> list[int]:
        """Ids without padding. Whole tokens match first, wherever they stand; the rest is words and runs of symbols."""
        out, at = [], 0
        for m in self._added.finditer(value):
            for word in re.findall(r"\w+|[^\w\s]+", value[at : m.start()]):
                out += self.pieces(word)
            out.append(self.ids[m[0]])
            at = m.end()
        for word in re.findall(r"\w+|[^\w\s]+", value[at:]):
            out += self.pieces(word)
        return out

    def encode(self, value: str) -> tuple[list[int], list[int]]:
        """Ids and attention mask of the fixed length."""
        ids = self.encode_all(value)[: self.length]
        gap = self.length - len(ids)
        return ids + [text.PAD] * gap, [1] * len(ids) + [0] * gap

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self._names.get(i, text.SPECIAL_TOKENS[text.UNK]) for i in ids)

    def save(self) -> str:
        return json.dumps({"ids": self.ids, "merges": self.merges, "whole": self.whole, "length": self.length})

    @classmethod
    def load(cls, value: str) -> Tokenizer:
        x = json.loads(value)
        return cls(x["ids"], [tuple(m) for m in x["merges"]], x["whole"], x["length"])


def learn_merges(words: dict[str, int], ids: dict[str, int], size: int) -> list[tuple[str, str]]:
    """Byte-pair merges over counted words until ``ids`` has ``size`` entries; ``ids`` is extended.

    The most frequent pair is merged next, of equals that with the smallest pair of ids. Pair counts are kept
    up to date by visiting only the words which hold the pair.
    """
    for c in sorted({c for w in words for c in w}):
        ids.setdefault(c, len(ids))
    split, counts = [], []
    for w, n in sorted(words.items()):
        parts = [c if k == 0 else PREFIX + c for k, c in enumerate(w)]
        for p in parts:
            ids.setdefault(p, len(ids))
        split.append(parts)
        counts.append(n)
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, parts in enumerate(split):
        for pair in zip(parts, parts[1:], strict=False):
            pairs[pair] += counts[k]
            where[pair].add(k)
    entry = lambda pair: (-pairs[pair], ids[pair[0]], ids[pair[1]], pair)
    queue = [entry(pair) for pair in pairs]
    heapq.heapify(queue)
    merges = []
    while len(ids) < size and queue:
        least, _, _, pair = heapq.heappop(queue)
        if -least != pairs[pair]:  # its count has changed since; a newer entry holds the count
            continue
        if least >= 0:
            break
        new = pair[0] + pair[1].removeprefix(PREFIX)
        ids.setdefault(new, len(ids))
        merges.append(pair)
        changed = set()
        for k in list(where[pair]):
            parts = split[k]
            for old in zip(parts, parts[1:], strict=False):
                pairs[old] -= counts[k]
                where[old].discard(k)
                changed.add(old)
            merged, at = [], 0
            while at < len(parts):
                if at + 1 < len(parts) and (parts[at], parts[at + 1]) == pair:
                    merged.append(new)
                    at += 2
                else:
                    merged.append(parts[at])
                    at += 1
            split[k] = merged
            for fresh in zip(merged, merged[1:], strict=False):
                pairs[fresh] += counts[k]
                where[fresh].add(k)
                changed.add(fresh)
        pairs[pair] = 0
        for other in changed - {pair}:
            heapq.heappush(queue, entry(other))
    return merges


def _merged(flat: np.ndarray, word: np.ndarray, x: int, y: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the word of each, with ``x, y`` within a word made ``new``, from left to right."""
    at = np.flatnonzero((flat[:-1] == x) & (flat[1:] == y) & (word[:-1] == word[1:]))
    if x == y and len(at):  # of a run of equal ids every second pair
        first = np.r_[True, np.diff(at) != 1]
        start = np.flatnonzero(first)
        at = at[(np.arange(len(at)) - start[np.cumsum(first) - 1]) % 2 == 0]
    if not len(at):
        return flat, word
    flat = flat.copy()
    flat[at] = new
    return np.delete(flat, at + 1), np.delete(word, at + 1)


def learn_merges_spread(words: DataFrame, ids: dict[str, int], size: int, kept: int = 16) -> list[tuple[str, str]]:
    """The merges of :func:`learn_merges` over a table ``token, n`` of any size.

    Pairs are counted on the executors, one job a merge, and only the pair to merge reaches the driver.
    The split words are kept anew after every ``kept`` merges.
    """
    letters = words.select("token", F.posexplode(F.split("token", "")).alias("at", "c")).filter("c <> ''")
    piece = F.when(F.col("at") == 0, F.col("c")).otherwise(F.concat(F.lit(PREFIX), "c"))
    first = letters.groupBy(piece.alias("piece")).agg(F.min(F.struct("token", "at")).alias("x")).orderBy("x").collect()
    for c in sorted({r["piece"].removeprefix(PREFIX) for r in first}):
        ids.setdefault(c, len(ids))
    for r in first:
        ids.setdefault(r["piece"], len(ids))

    def spelled(batch: pa.RecordBatch, late: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        parts = batch.column(0)
        flat, word = parts.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        for x, y, new in late:
            flat, word = _merged(flat, word, x, y, new)
        return flat, word

    def rewritten(late: list[tuple[int, int, int]]):
        def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                flat, word = spelled(batch, late)
                ends = np.searchsorted(word, np.arange(batch.num_rows + 1))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), batch.column(1)], ["parts", "n"]).filter(pa.array(np.diff(ends) > 1))  # one piece has no pair

        return rewrite

    def counted(late: list[tuple[int, int, int]]):
        def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            pairs: Counter = Counter()
            for batch in batches:
                flat, word = spelled(batch, late)
                inside = np.flatnonzero(word[:-1] == word[1:])
                keys, place = np.unique(flat[inside].astype(np.int64) << 32 | flat[inside + 1], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, batch.column(1).to_numpy()[word[inside]])
                for key, n in zip(keys.tolist(), sums.tolist(), strict=True):
                    pairs[key] += n
            yield pa.record_batch([pa.array([k >> 32 for k in pairs], pa.int32()), pa.array([k & 0xFFFFFFFF for k in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], ["x", "y", "n"])

        return count

    named = F.create_map(*[F.lit(v) for r in first for v in (r["piece"], ids[r["piece"]])]) if first else F.lit(None).cast("map<string,int>")
    pieces = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c, k: F.element_at(named, F.when(k == 0, c).otherwise(F.concat(F.lit(PREFIX), c))))
    state = staged(words.select(pieces.alias("parts"), F.col("n").cast("long").alias("n")), "merges")
    merges: list[tuple[str, str]] = []
    late: list[tuple[int, int, int]] = []
    names = {v: k for k, v in ids.items()}
    while len(ids) < size:
        if len(late) == kept:
            state = staged(state.mapInArrow(rewritten(late), "parts array<int>, n long"), "merges")
            late = []
        pairs = state.mapInArrow(counted(late), "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        best = pairs.agg(F.min(F.struct((-F.col("n")).alias("n"), "x", "y")).alias("best")).first()["best"]
        if best is None or best["n"] >= 0:
            break
        pair = (names[best["x"]], names[best["y"]])
        new = ids.setdefault(pair[0] + pair[1].removeprefix(PREFIX), len(ids))
        names[new] = pair[0] + pair[1].removeprefix(PREFIX)
        merges.append(pair)
        late = [*late, (best["x"], best["y"], new)]
    return merges


def train_tokenizer(counts: DataFrame, length: int = 512, size: int = 4096, most_words: int = 1_000_000) -> Tokenizer:
    """A tokenizer from the table of counts.

    Counting is distributed. Up to ``most_words`` distinct immediates are merged on the driver, more of them on the
    executors, with equal results. Every whole token gets an id. Counts are weights and never expanded.
    """
    ids = {t: k for k, t in enumerate(text.SPECIAL_TOKENS)}
    immediates = counts.filter("kind = 'immediates'").select("token", "n")
    if immediates.count() <= most_words:
        merges = learn_merges({r["token"]: r["n"] for r in immediates.collect()}, ids, size)
    else:
        merges = learn_merges_spread(immediates, ids, size)
    others = counts.filter("kind = 'tokens'").orderBy(F.col("n").desc(), "token").collect()
    whole = [r["token"] for r in others if r["token"] not in text.SPECIAL_TOKENS]
    for t in whole:
        ids.setdefault(t, len(ids))
    return Tokenizer(ids, merges, whole, length)


def tokenize(df: DataFrame, tokenizer: Tokenizer, column: str = "disassembly") -> DataFrame:
    """Add ``tokens`` and ``mask`` of the tokenizer's length; Arrow batches, the tokenizer sent once per executor."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("tokens array<int>, mask array<int>")
    def encode(values: pa.Array) -> pa.Array:
        ends = pa.array(np.arange(len(values) + 1) * shared.value.length, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in shared.value.encode_batch(values)], ["tokens", "mask"])

    out = validate(df, DisassembledFunctionDataset).withColumn("_encoded", encode(F.col(column)))
    return out.withColumn("tokens", F.col("_encoded.tokens")).withColumn("mask", F.col("_encoded.mask")).drop("_encoded")


def detokenize(df: DataFrame, tokenizer: Tokenizer, column: str = "tokens", target: str = "text") -> DataFrame:
    """Add the text of ids, special tokens included."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        names = shared.value._names
        known = pa.array([*names.values(), text.SPECIAL_TOKENS[text.UNK]])
        flat = pc.fill_null(pc.index_in(values.flatten(), pa.array(list(names), pa.int32())), len(names))
        n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32(), mask=np.r_[values.is_null().to_numpy(zero_copy_only=False), False])
        return pc.binary_join(pa.ListArray.from_arrays(ends, known.take(flat)), " ")

    return df.withColumn(target, decode(F.col(column)))
