"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document goes to the open bin after which the squared counts of open bins per
residual gap sum to least (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006).
Bins with equal gaps are alike, so the state is one histogram of gaps, and a step is a
handful of numpy operations on it, however many bins are open.
"""

from __future__ import annotations

import contextlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import release, text_blocks

#: Chunks whose ids one Python worker remembers, besides as many from before.
REMEMBERED = 200_000
#: Bytes of text whose new chunks go to the tokenizer together.
BLOCK = 2 << 20
#: Pieces that one packing task receives on average, and bytes of text that a piece holds at least half of, if long texts are cut.
GROUP_ROWS, PIECE_BYTES = 20_000, 8192

#: Texts of these characters alone, with neither apostrophe nor special token, have boundaries at all symbols.
_PLAIN = re.compile(r"[\t\n\r\x20-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_SYMBOLS = re.compile(r"[!-/:-@\[-`{-~]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"

class Encoder:
    """Ids of a text as little-endian bytes, one white-space chunk at a time.

    The tokenizer's own rules split at white space and never merge across it, so a
    text's ids are those of its chunks in turn; chunks repeat, and most are remembered.
    It also lowers letters and parts words from runs of symbols, so doing the same first changes
    nothing and makes chunks repeat more; texts that are not plain are left as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.seen, self.old = Tokenizer.from_file(path), {}, {}
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.is_end[[k for token, k in vocab.items() if token.endswith("</w>")]] = True

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is new in all of them goes to the tokenizer at once."""
        if len(self.seen) > REMEMBERED:
            self.old, self.seen = self.seen, {}
        out: list[list] = []
        gaps: list[tuple[list, list[str], list[int]]] = []
        new: set[str] = set()
        get = self.seen.get
        for text in texts:
            if "<|" not in text and _PLAIN.fullmatch(text):
                chunks = _SYMBOLS.sub(r" \g<0> ", text.lower()).split()
            elif any(x in text for x in _SEPARATORS):  # Python splits there, the tokenizer takes them for symbols
                chunks = text.replace("\n", " ").split(" ")
            else:
                chunks = text.split()
            found = list(map(get, chunks))
            if None in found:
                at, k = [], -1
                with contextlib.suppress(ValueError):
                    while True:
                        k = found.index(None, k + 1)
                        at.append(k)
                gaps.append((found, chunks, at))
                new.update([chunks[k] for k in at])
            out.append(found)
        self._learn(new)
        for found, chunks, at in gaps:
            for k in at:
                found[k] = self.seen[chunks[k]]
        return [b"".join(x) for x in out]

    def _learn(self, new: set[str]) -> None:
        """Remember chunks, from before or from the tokenizer."""
        known = new & self.old.keys()
        self.seen.update({c: self.old[c] for c in known})
        new = new - known
        self._together([c for c in new if c.isalpha() and _PLAIN.fullmatch(c)])
        left = [c for c in new if c not in self.seen]
        for c, e in zip(left, self.tokenizer.encode_batch_fast(left, add_special_tokens=False), strict=True):
            self.seen[c] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        """Remember words of Latin-1 letters, encoded as one text: each is one word to the tokenizer, and ends where an end-of-word id stands."""
        if not words:
            return
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.nonzero(self.is_end[ids])[0] + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return  # not as expected: the caller encodes them one by one
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.seen[word] = raw[at:end]
            at = end


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: tasks that follow each other share what it remembers."""
    return Encoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Cut every document's ids, with ``end_id`` after them, into pieces of at most ``capacity``.

    Returns ``doc_id, piece, start, length, ids_crc32`` and ``again``, which tells equal pieces apart: the task, and how many equal
    ones came before it there. Only documents longer than ``capacity`` are cut. Null text is empty: one id.
    """
    path = tokenizer or tokenizer_path()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId() << 32
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for at, texts in text_blocks(batch.column(1), BLOCK, raw=False):
                ids_of = batch.column(0).slice(at, len(texts)).to_pylist()
                for doc_id, raw in zip(ids_of, encode.many(texts), strict=True):
                    ids = memoryview(raw + end)
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        crc = zlib.crc32(part)
                        # equal pieces stand for each other, so the number does not depend on the order in which a task gets them
                        n = seen[key] = seen.get(key := hash((doc_id, piece, crc)), -1) + 1
                        for column, x in zip(out, (doc_id, piece, start // 4, len(part) // 4, crc, task + n), strict=True):
                            column.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32", "again"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, again long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in descending order of length.

    An item of length s goes to the gap g >= s for which the sum of squared counts grows
    least: one bin leaves gap g and one enters gap g - s, which adds 2 * (n[g-s] - n[g] + 1),
    or 1 - 2 * n[g] where the bin is full then. Ties go to the tightest gap. A bin is opened only
    if the item fits no open bin. Equal lengths follow each other, so each run reuses one histogram slice.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in order:
        s = int(lengths[k])
        here = n[s:]
        fits = np.nonzero(here)[0]
        if len(fits):
            cost = 2 * (n[fits] - here[fits]) + 2
            if fits[0] == 0:
                cost[0] = 1 - 2 * here[0]
            g = s + int(fits[np.argmin(cost)])
            b = stacks[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, opened
            opened += 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            n[g - s] += 1
            stacks[g - s].append(b)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``; offsets of a sequence follow each other from 0 without gaps.

    Pieces are dealt by hash to groups of about ``group_rows``, and each group is packed by itself. Equal pieces, with or
    without an id, are dealt apart, so that no group grows with the input, however long the texts and however often one repeats. A bin is opened
    only where no open bin fits, so a group leaves at most one bin that is less than half full, of thousands. Rows that repeat a doc_id are packed like any others, pieces of equal length in any order. Null text is
    empty, an empty table gives an empty result, and extra columns are ignored.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-(rows + size // PIECE_BYTES) // group_rows))
    cut = pieces(docs, tokenizer, end_id, capacity).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "again"), F.lit(groups))).drop("again")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="grp").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return cut.groupBy("grp").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
