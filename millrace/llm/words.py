"""Words of raw UTF-8 texts as 64-bit keys, for numpy code: many texts at a time, no object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_C = ctypes.CDLL(None)

#: Bytes of text that are held as arrays at once (a text is never cut), and bytes whose word keys are computed at once.
BLOCK, SPAN = 1 << 19, 1 << 17
#: Longer words get their key one by one.
LONG = 1 << 12
#: An odd multiplier: the key of a word is a polynomial in it of the word's bytes, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out, k = np.ones(SPAN + LONG, dtype=np.uint64), 1
    while k < len(out):
        out[k : 2 * k] = out[: min(k, len(out) - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return blank, _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads close values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row as bytes, where each word starts and ends in it, and where each text ends (a blank stands there)."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    edge = np.nonzero(np.diff(_tables()[0][raw]))[0] + 1
    return raw, edge[::2], edge[1::2], np.cumsum([len(t) + 1 for t in texts])


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """uint64 key of each word of all texts in a row, and the place after each text's last word.

    Words are runs of anything but ASCII white space. Equal words have equal keys; different ones meet with a chance of about 2**-56.
    """
    raw, starts, ends, stops = word_spans(texts)
    return keys_of(raw, starts, ends), np.searchsorted(starts, stops)


def keys_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the words of ``raw`` that lie between ``starts`` and ``ends``."""
    _, up, down = _tables()
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = int(np.searchsorted(starts, lo + SPAN))
        part = raw[lo : min(lo + SPAN + LONG, max(ends[to - 1], lo + 1))]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        first = starts[at:to] - lo
        out[at:to] = (sums[np.minimum(ends[at:to] - lo, len(part))] - sums[first]) * down[first]
        at = to
    for k in np.nonzero(ends - starts > LONG)[0]:
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return mixed64(out)


def windows(keys: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each run of ``n`` words; of the whole sequence where it is shorter; none for none."""
    if len(keys) == 0:
        return keys
    n = min(n, len(keys))
    count = len(keys) - n + 1
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += keys[k : k + count]
        out ^= out >> np.uint64(29)
    return mixed64(out)


def raw_texts(column: pa.Array) -> list[bytes]:
    """Bytes of a binary or string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_blocks(column: pa.Array, size: int = BLOCK, raw: bool = True) -> Iterator[tuple[int, list]]:
    """Runs of a column's texts of about ``size`` bytes, each with the place of its first: a batch is never held twice as a whole.

    Texts are bytes in UTF-8, or ``str`` unless ``raw``; null is empty.
    """
    upto = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        some = column.slice(at, to - at)
        yield at, raw_texts(some) if raw else [x or "" for x in some.to_pylist()]
        at = to


def release() -> None:
    """Hand memory that Arrow and the C library keep for later back to the system: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)
