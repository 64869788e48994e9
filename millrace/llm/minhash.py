"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document's set of word shingles has ``TREES`` signatures of ``DEPTH`` minimum hashes. In
each tree, documents are sorted by their signature, so that neighbours are those
with the longest common prefix (Bawa, Condie and Ganesan, 2005). A document is
compared with the neighbours before it, and regions of the order which still hold several
components are then searched, to a depth that adapts to how many there are.
Candidates are screened by their signatures and confirmed on the full sets. The forest finds nearly all
links quickly but promises none, so what it leaves apart is then searched exactly: two sets of the similarity
share a shingle among the first quarter of each, in any one order of all shingles (Chaudhuri,
Ganti and Kaushik, 2006), here the rare ones first. Nothing there is screened, capped or sampled.

The sort is a range partition by the whole signature and the document, so a group of copies of any
size is spread over tasks; equal sets were merged before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, scratch, small, stage
from .components import components
from .words import raw_texts, release, text_blocks, windows, word_keys

TREES, DEPTH = 12, 6
#: A region is the documents of a tree with this many minima in common, and is compared whole up to so many
#: components; larger regions part by their next minimum.
LEAST_DEPTH, REGION = 2, 512
#: Neighbours in the order that a document is compared with.
WINDOW = 12
#: Share of equal minima from which the forest has a pair confirmed: three deviations below 0.75.
SCREEN = 0.6
#: Documents whose shingles tell which ones are frequent: at least so many, and at least this part of all of them. A frequent one is held by
#: so many of the sample at least, and at most so many are listed, the most frequent. This sets the order, and which way a shingle goes.
SAMPLE, SHARE, FREQUENT, LISTED = 20_000, 0.02, 3, 500_000
#: Holders, by the sample, from which a shingle is hot: its holders never meet in one task, they are counted and dealt out in blocks.
HOT = 2_000
#: Most bits of the parities that rule a pair out.
PARITY_BITS = 1 << 17
#: Holders of one shingle up to which their pairs are found where the shingle is; more are dealt out in blocks of so many.
FEW, BLOCK = 64, 1024
#: Shingles that one task of the exact search receives on average, and most that a task holds before it hands them on.
BUCKET, HELD = 250_000, 1_000_000
#: From here on stand the numbers of sets whose doc_id has other sets too.
FURTHER = 1 << 62


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Of each text in UTF-8, the sorted distinct hashes of its ``n``-word shingles, A-Z lowered."""
    keys, ends = word_keys([t.lower() for t in texts])
    every, out, lo = windows(keys, n), [], 0
    for hi in ends.tolist():
        own = np.sort(every[lo : hi - n + 1] if hi - lo >= n else windows(keys[lo:hi], n))
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
        lo = hi
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_FAMILY = np.random.default_rng(20240229).integers(1, 2**31, size=(TREES * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` minimum hashes (uint32, by multiply-shift) of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FAMILY), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_FAMILY * x[at : at + 2048]).min(axis=1), out=out)
    return out


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of about twice as many classes of hashes as there are shingles: whether their number is odd.

    Two sets differ in at least as many shingles as their bits differ, so this rules pairs out
    without error (Sandes, Teodoro and Melo, 2020). Halves folded by XOR are the parities of half as many classes.
    """
    bits = min(PARITY_BITS, 1 << max(6, (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """Number of shingles in which two sets differ, at least, by their parities."""
    a, b = (np.frombuffer(z, np.uint64) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Frequent:
    """Which shingles are frequent, and how much."""

    BITS = 23

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self._class(tokens)] = True

    def _class(self, tokens: np.ndarray) -> np.ndarray:
        return tokens & np.uint64((1 << self.BITS) - 1)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Count of each token, 0 where it is not frequent."""
        out = np.zeros(len(tokens), dtype=np.int64)
        at = np.nonzero(self.maybe[self._class(tokens)])[0]
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[place] == tokens[at], self.counts[place], 0)
        return out


def _prefix(s: np.ndarray, frequent: Frequent, hundredths: int) -> np.ndarray:
    """The shingles of which every set alike enough shares one, in the order that all sets have in common: frequent ones last."""
    length = len(s) - (hundredths * len(s) + 99) // 100 + 1
    times = frequent.of(s)
    rare = s[times == 0]
    return rare[:length] if len(rare) >= length else s[np.argsort(times, kind="stable")[:length]]


def sketches(docs: DataFrame, n: int, hundredths: int, listed: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, sig, parity, prefix`` of every row; an empty set has none of the last four.

    ``text_key`` is a hash of the text as it stands. Equal sets have equal digests (128 bits of BLAKE2). ``sig`` holds the
    minima, big-endian, tree after tree, and ``prefix`` the shingles (uint64) that the exact search looks at, those ``listed`` as frequent last.
    """
    known = docs.sparkSession.sparkContext.broadcast(listed)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(*known.value)
        for batch in batches:
            for at, texts in text_blocks(batch.column(2)):
                sets = shingle_sets(texts, n)
                of = lambda f, sets=sets: pa.array([f(s) if len(s) else None for s in sets], pa.binary())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(1).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        of(_digest),
                        of(lambda s: minima(s).astype(">u4").tobytes()),
                        of(parity),
                        of(lambda s: _prefix(s, frequent, hundredths).tobytes()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "sig", "parity", "prefix"],
                )
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("raw")).mapInArrow(
        sketch, "doc_id long, text_key long, n_shingles long, digest binary, sig binary, parity binary, prefix binary"
    )


def forest(reps: DataFrame) -> DataFrame:
    """A row per document and tree: ``tree, prefix, sketch, node, size`` (and ``comp`` where ``reps`` has it), in tree order.

    ``prefix`` is the tree's signature; ``sketch`` the low byte of every minimum, for screening.
    """
    width = 4 * DEPTH
    more = ["comp", "copies"] if "comp" in reps.columns else []
    low = F.concat(*[F.substring("sig", 4 * k + 4, 1) for k in range(TREES * DEPTH)])
    rows = reps.withColumn("sketch", low).select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * width + 1, width).alias("prefix")) for t in range(TREES)])).alias("x"),
        "sketch", "node", "size", *more,
    )
    return rows.select("x.tree", "x.prefix", "sketch", "node", "size", *more)


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {
        "sketch": np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH),
        "prefix": np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u4").reshape(-1, DEPTH),
        "tree": batch.column("tree").to_numpy(),
        "node": batch.column("node").to_numpy(),
        "size": batch.column("size").to_numpy(),
    }
    if "comp" in batch.schema.names:
        out["comp"] = batch.column("comp").to_numpy()
    return out


_PAIRS = "a long, b long, tree int, alike double"


def _pairs(a: np.ndarray, b: np.ndarray, tree: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.record_batch([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(tree.astype(np.int32)), pa.array(alike, pa.float64())], ["a", "b", "tree", "alike"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=-1)


def neighbours(rows: DataFrame, least: float) -> DataFrame:
    """For each row of :func:`forest`, the most alike of the ``WINDOW`` rows before it in its region: ``a, b, tree, alike``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _arrays(batch)
            x = new if tail is None else {k: np.concatenate([tail[k], new[k]]) for k in new}
            first = 0 if tail is None else len(tail["node"])
            best, at = np.zeros(len(x["node"])), np.zeros(len(x["node"]), dtype=np.int64)
            for lag in range(1, min(WINDOW, len(best) - 1) + 1):
                i = np.arange(max(first, lag), len(best))
                i = i[(x["tree"][i] == x["tree"][i - lag]) & (x["prefix"][i, :LEAST_DEPTH] == x["prefix"][i - lag, :LEAST_DEPTH]).all(axis=1)]
                small, large = np.minimum(x["size"][i], x["size"][i - lag]), np.maximum(x["size"][i], x["size"][i - lag])
                i = i[(small >= least * large) & (x["node"][i] != x["node"][i - lag])]
                got = _alike(x["sketch"][i], x["sketch"][i - lag])
                better = got > best[i]
                best[i[better]], at[i[better]] = got[better], i[better] - lag
            hit = np.nonzero(best >= SCREEN)[0]
            if len(hit):
                yield _pairs(x["node"][hit], x["node"][at[hit]], x["tree"][hit], best[hit])
            tail = {k: v[-WINDOW:] for k, v in x.items()}

    ordered = rows.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    return ordered.mapInArrow(walk, _PAIRS)


def regions(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of different components in each region: ``a, b, tree, alike``.

    A region of more than ``REGION`` such rows parts by its next minimum; at full depth, rows in
    order are compared block by block with the block before.
    """

    def search(x: dict[str, np.ndarray], at: np.ndarray, depth: int) -> Iterator[tuple]:
        if len(at) < 2:
            return
        if len(at) > REGION and depth < DEPTH:
            key = x["prefix"][at, depth]
            for part in np.split(at, np.nonzero(key[1:] != key[:-1])[0] + 1):
                yield from search(x, part, depth + 1)
            return
        step = REGION // 4
        for lo in range(0, len(at), step):
            i = at[lo : lo + step]
            j = at[(lo if len(at) <= REGION else max(0, lo - step)) if lo else 0 : len(at) if len(at) <= REGION else lo + step]
            got = _alike(x["sketch"][i][:, None, :], x["sketch"][j][None, :, :])
            small = np.minimum(x["size"][i][:, None], x["size"][j][None, :])
            large = np.maximum(x["size"][i][:, None], x["size"][j][None, :])
            p, q = np.nonzero((got >= SCREEN) & (small >= least * large) & (x["comp"][i][:, None] != x["comp"][j][None, :]) & (i[:, None] < j[None, :]))
            if len(p):
                yield x["node"][i[p]], x["node"][j[q]], x["tree"][i[p]], got[p, q]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def done(x: dict[str, np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            same = (x["tree"][1:upto] == x["tree"][: upto - 1]) & (x["prefix"][1:upto, :LEAST_DEPTH] == x["prefix"][: upto - 1, :LEAST_DEPTH]).all(axis=1)
            for part in np.split(np.arange(upto), np.nonzero(~same)[0] + 1):
                for found in search(x, part, LEAST_DEPTH):
                    yield _pairs(*found)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = _arrays(batch)
            x = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
            # the last region may go on in the next batch
            open_at = np.nonzero((x["tree"] != x["tree"][-1]) | (x["prefix"][:, :LEAST_DEPTH] != x["prefix"][-1, :LEAST_DEPTH]).any(axis=1))[0]
            cut = int(open_at[-1]) + 1 if len(open_at) else 0
            if cut:
                yield from done(x, cut)
            held = {k: v[cut:] for k, v in x.items()}
        if held is not None and len(held["node"]):
            yield from done(held, len(held["node"]))

    ordered = rows.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    return ordered.mapInArrow(walk, _PAIRS)


def confirm(pairs: DataFrame, texts: DataFrame, n: int, hundredths: int) -> DataFrame:
    """The ``pairs`` (``a, b``) whose full shingle sets reach the similarity; ``texts`` has ``node, raw``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep, sides, nodes = [], batch.column(3), batch.column(1).to_pylist()
            for at, others in text_blocks(batch.column(2)):
                for k, other in enumerate(shingle_sets(others, n), at):
                    if nodes[k] != last:
                        last, own = nodes[k], shingle_sets([sides[k].as_py()], n)[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= hundredths * (len(own) + len(other) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    side = lambda name: texts.select(F.col("node").alias(name), F.col("raw").alias(f"raw_{name}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b").mapInArrow(check, "a long, b long")


def possible(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The ``pairs`` (``a, b``) that parities do not rule out; ``sets`` has ``node, size, parity``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.array([differ(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + hundredths) * least <= (100 - hundredths) * total))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").cast("long").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(check, "a long, b long")


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the shingles frequent in a sample that grows with the corpus, their counts there, and its share; equal texts count once.

    The sample is counted on the executors, and the driver receives the most frequent ``LISTED`` at most.
    """
    rows = docs.count()
    share = min(1.0, max(SHARE, SAMPLE / max(1, rows)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch.column(0)):
                sets = shingle_sets(texts, n)
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["token"])
        release()

    some = docs.filter(F.pmod(F.xxhash64("text", F.lit("order")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    some = some.select(F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("raw")).dropDuplicates(["key"])
    counted = some.select("raw").mapInArrow(explode, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    counted = stage(counted, "near-frequent")
    # the least count whose shingles, with all more frequent ones, are within the bound
    sizes = counted.groupBy(F.floor(F.log2("n") * 32).alias("b")).agg(F.min("n").alias("low"), F.count("*").alias("size")).orderBy(F.col("b").desc()).collect()
    total = np.cumsum([r["size"] for r in sizes])
    low = [r["low"] for r, t in zip(sizes, total, strict=True) if t <= LISTED]
    got = counted.filter(F.col("n") >= (low[-1] if low else 1 << 62)).toArrow()
    drop_stage(counted)
    token = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], got.column("n").to_numpy()[order], share


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: four each where none is negative or larger, else eight."""
    return x.astype("<u4" if x.min() >= 0 and x.max() < 1 << 32 else "<i8").tobytes()


def _unpacked(parts: list[bytes], counts: list[int]) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, "<u4" if len(p) == 4 * k else "<i8").astype(np.int64) for p, k in zip(parts, counts, strict=True)])


def _pairs_within(token: np.ndarray, x: dict[str, np.ndarray], hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows with equal tokens, in order, whose sets may reach the similarity and are in different components."""
    left, right = [], []
    at = np.arange(len(token))
    for lag in range(1, len(token)):
        at = at[at + lag < len(token)]
        at = at[token[at] == token[at + lag]]
        if not len(at):
            break
        i, j = at, at + lag
        ok = x["comp"][i] != x["comp"][j]
        i, j = i[ok], j[ok]
        p, q = x["size"][i], x["size"][j]
        # of the first shingle that they share, no more can be shared than what follows it
        rest = np.minimum(p - x["pos"][i], q - x["pos"][j])
        ok = (hundredths * np.maximum(p, q) <= 100 * np.minimum(p, q)) & ((100 + hundredths) * rest >= hundredths * (p + q))
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def _among(token: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are in the sorted array ``listed``, and where."""
    at = np.minimum(np.searchsorted(listed, token), max(0, len(listed) - 1))
    return (listed[at] == token) if len(listed) else np.zeros(len(token), dtype=bool), at


def hot_holders(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """``token, node, comp, size, pos, blocks`` of all holders of those ``hot`` shingles (sorted) that sets of different components have in their prefixes.

    Each task counts the hot shingles of its sets first, a row for each at most, so that what has many holders
    is known before they meet; ``blocks`` is how many they are to be dealt out to.
    """
    sc = sets.sparkSession.sparkContext
    listed = sc.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        n, lo, hi = np.zeros(len(known), np.int64), np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        for batch in batches:
            for comp, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, at = _among(np.frombuffer(raw.as_py(), np.uint64), known)
                at = at[found]
                n[at] += 1
                lo[at], hi[at] = np.minimum(lo[at], comp), np.maximum(hi[at], comp)
        there = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(known[there].view(np.int64)), *(pa.array(x[there]) for x in (n, lo, hi))], ["token", "n", "lo", "hi"])

    sums = sets.select("comp", "prefix").mapInArrow(count, "token long, n long, lo long, hi long").groupBy("token").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = sums.filter("lo <> hi").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).toArrow()  # of the listed ones
    token, blocks = mixed.column("token").to_numpy().view(np.uint64), mixed.column("blocks").to_numpy()
    order = np.argsort(token)
    dealt = sc.broadcast((token[order], blocks[order]))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = dealt.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [_among(np.frombuffer(raw.as_py(), np.uint64), known) for raw in part.column(3)]
                pos = [np.nonzero(found)[0] for found, _ in own]
                where, row = np.concatenate([i[p] for (_, i), p in zip(own, pos, strict=True)]), np.repeat(np.arange(len(own)), [len(p) for p in pos])
                columns = [pa.array(known[where].view(np.int64)), *(part.column(k).take(pa.array(row)) for k in range(3)), pa.array(np.concatenate(pos)), pa.array(blocks[where])]
                yield pa.record_batch(columns, ["token", "node", "comp", "size", "pos", "blocks"])

    return sets.select("node", "comp", F.col("size").cast("long"), "prefix").mapInArrow(give, "token long, node long, comp long, size long, pos long, blocks int")


def shared_shingles(sets: DataFrame, buckets: int, hundredths: int, hot: np.ndarray) -> DataFrame:
    """What the prefixes of sets of different components share: ``a, b, token, node, comp, size, pos``.

    ``sets`` has ``node, comp, size, prefix``. Shingles go to tasks by their top bits, as arrays: most are of one set only and
    never become rows. Of a shingle of up to ``FEW`` sets, the pairs ``a, b`` that may reach the similarity are given; of
    others all holders, for :func:`left_apart` to deal out. As frequent shingles stand last, few are in prefixes; those
    that are ``hot`` go by :func:`hot_holders` and are left out here, so a task gets no more of one shingle than a cold one has holders.
    """
    listed = sets.sparkSession.sparkContext.broadcast(hot)
    shift = np.uint64(64 - max(1, buckets.bit_length() - 1))
    kinds = ("node", "comp", "size", "pos")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sets: list[tuple[int, int, int]] = []
        total, known = 0, listed.value

        def out() -> Iterator[pa.RecordBatch]:
            token, lengths = np.concatenate(held), [len(x) for x in held]
            owner, pos = np.repeat(np.arange(len(held), dtype=np.int32), lengths), np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            order = np.argsort(token)
            if len(known):
                order = order[~_among(token[order], known)[0]]
            if not len(order):
                return
            token, owner, pos, of = token[order], owner[order], pos[order], np.array(sets, dtype=np.int64)
            at = token >> shift
            cuts = np.append(np.append(0, np.nonzero(at[1:] != at[:-1])[0] + 1), len(at)).tolist()
            for some in range(0, len(cuts) - 1, 64):
                ranges = list(zip(cuts[some : some + 64], cuts[some + 1 : some + 65]))  # noqa: B905
                columns = [pa.array([token[lo:hi].tobytes() for lo, hi in ranges], pa.binary())]
                columns += [pa.array([_packed(of[owner[lo:hi], c]) for lo, hi in ranges], pa.binary()) for c in range(3)]
                columns += [pa.array([_packed(pos[lo:hi]) for lo, hi in ranges], pa.binary())]
                yield pa.record_batch([pa.array([int(at[lo]) for lo, _ in ranges], pa.int64()), *columns], ["bucket", "token", *kinds])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for row, raw in zip(rows, batch.column(3), strict=True):
                held.append(np.frombuffer(raw.as_py(), np.uint64))
                sets.append(row)
                total += len(held[-1])
                if total > HELD:
                    yield from out()
                    held, sets, total = [], [], 0
        if held:
            yield from out()
        release()

    def find(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("token", *kinds)}
        counts = [len(x) // 8 for x in raw["token"]]
        token = np.frombuffer(b"".join(raw["token"]), np.uint64)
        order = np.argsort(token)
        token = token[order]
        starts = np.nonzero(np.append(True, token[1:] != token[:-1]))[0]
        long = np.diff(np.append(starts, len(token)))
        comp = _unpacked(raw["comp"], counts)[order]
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        every, many = np.repeat(mixed, long), np.repeat(mixed & (long > FEW), long)
        x = {c: _unpacked(raw[c], counts)[order][every] for c in kinds}
        own, many = token[every], many[every]
        few = {c: v[~many] for c, v in x.items()}
        i, j = _pairs_within(own[~many], few, hundredths)
        ends = np.sort(np.stack([few["node"][i], few["node"][j]]), axis=0)
        pairs = np.unique(ends, axis=1) if len(i) else ends
        return pa.concat_tables(
            [
                pa.table({"a": pairs[0], "b": pairs[1]}),
                pa.table({"token": own[many].view(np.int64)} | {c: v[many] for c, v in x.items()}),
            ],
            promote_options="default",
        )

    dealt = sets.select("node", "comp", F.col("size").cast("long"), "prefix").mapInArrow(deal, "bucket long, token binary, node binary, comp binary, size binary, pos binary")
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(find, "a long, b long, token long, node long, comp long, size long, pos long")


def left_apart(sets: DataFrame, hundredths: int, hot: np.ndarray) -> DataFrame:
    """Every pair of different components that may reach the similarity, by shared prefixes: ``a, b``. Nothing is capped.

    ``sets`` has ``node, size, comp, prefix``. A shingle of many documents is dealt out in blocks, each with each other; the holders of one
    of the ``hot`` are dealt out before they meet.
    """
    total = sets.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    found = stage(shared_shingles(sets, max(16, 1 << (total // BUCKET).bit_length()), hundredths, hot), "near-held")
    held = found.filter("token is not null").drop("a", "b")
    blocks = stage(held.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "near-blocks")
    columns = ["token", "node", "comp", "size", "pos", "blocks"]
    known = held.join(small(blocks), "token").select(*columns)
    if len(hot):
        known = known.union(stage(hot_holders(sets, hot), "near-hot").select(*columns))
    dealt = (
        known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp", "size", "pos")
    )
    side = lambda x: dealt.select("token", "lo", "hi", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "node", "comp", "size", "pos")])
    pairs = side("a").join(side("b"), ["token", "lo", "hi"]).filter("node_a < node_b and comp_a <> comp_b and (lo = hi or block_a <> block_b)")
    pairs = pairs.filter(f"{hundredths} * greatest(size_a, size_b) <= 100 * least(size_a, size_b)")
    pairs = pairs.filter(f"{100 + hundredths} * least(size_a - pos_a, size_b - pos_b) >= {hundredths} * (size_a + size_b)")
    return found.filter("token is null").select("a", "b").union(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, hundredths: int = 75) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    Documents are linked if their sets of ``n``-word shingles have a Jaccard similarity of at
    least ``hundredths`` / 100; ``component_id`` is the smallest doc_id reachable, ``kept`` marks the
    document with that id. Equal sets are merged first and count as linked. ``text_key`` is xxhash64 of the text.

    A text with fewer words than ``n`` has the whole sequence as its one shingle. Null text or text
    without words has no shingles and stays alone. A null doc_id can neither link nor be a
    component: such a row has a null component and is kept. Rows that repeat a doc_id are judged
    each by its own text; with equal texts all of them are kept or none. Whole texts count, however long. Empty
    tables give empty results, and further columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        kept.append(stage(_near_duplicates(docs, n, hundredths), "near-documents"))
    return kept[0]


def _near_duplicates(docs: DataFrame, n: int, hundredths: int) -> DataFrame:
    least = hundredths / 100
    token, times, share = frequent_shingles(docs, n)
    hot = token[times >= HOT * share]
    rows = stage(sketches(docs, n, hundredths, (token, times)), "near-sketches")
    shared = stage(
        rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"),
        "near-shared",
    )
    named = rows.join(small(shared), "digest", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    known = stage(named.select("doc_id", "text_key", "n_shingles", "digest", "rep"), "near-known")
    first = named.filter("digest is not null and doc_id = rep").select("rep", "text_key", F.col("n_shingles").alias("size"), "digest", F.coalesce("copies", F.lit(1)).alias("copies"), "sig", "parity", "prefix")
    reps = stage(first.filter("copies = 1").union(first.filter("copies > 1").dropDuplicates(["rep", "digest"])), "near-reps")
    drop_stage(rows)
    # a doc_id with several sets has further numbers for all but one of them
    twice = stage(reps.groupBy("rep").agg(F.min("digest").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "near-twice")
    several = bool(twice.limit(1).count())
    if several:
        further = (F.lit(FURTHER) + F.xxhash64("digest").bitwiseAND(F.lit((1 << 61) - 1))).alias("node")
        nodes = stage(reps.join(twice, "rep").filter("digest <> least").select("digest", further), "near-nodes")
        reps = reps.join(small(nodes), "digest", "left").withColumn("node", F.coalesce("node", "rep"))
    else:
        reps = reps.withColumn("node", F.col("rep"))

    raw = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("raw"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ids")
        ids = stage(reps.select("node", "rep", "text_key").join(small(ids), "node", "left_semi"), "near-ids")
        texts = stage(raw.join(small(ids), ["rep", "text_key"]).select("node", "raw"), "near-texts")
        return texts if texts.count() == ids.count() else texts.dropDuplicates(["node"])

    def links_of(pairs: DataFrame) -> DataFrame:
        open_pairs = stage(possible(stage(pairs, "near-more"), reps, hundredths), "near-open")
        return stage(confirm(open_pairs, texts_of(open_pairs), n, hundredths), "near-links")

    # Round 1: the most alike neighbour of each document in each tree.
    found = stage(neighbours(forest(reps), least).groupBy("a", "b").agg(F.min("tree").alias("tree"), F.max("alike").alias("alike")), "near-found")
    texts = texts_of(found)
    # The first trees' pairs join most of what belongs together; of the others only those that still part components.
    comp = components(stage(confirm(found.filter("tree < 2"), texts, n, hundredths), "near-links"))
    comp = merge(comp, stage(confirm(stage(_apart(found.filter("tree >= 2"), comp), "near-rest"), texts, n, hundredths), "near-links"))
    # Round 2: whole regions; for each component in them stand the document with most copies and another.
    labelled = _with_comp(reps, comp)
    trees = forest(labelled).withColumn("region", F.xxhash64("tree", F.substring("prefix", 1, 4 * LEAST_DEPTH)))
    several_in = trees.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("region")
    row, by_chance = F.struct("prefix", "sketch", "node", "size"), lambda salt: F.xxhash64("node", "tree", F.lit(salt))
    keys = [F.struct(-F.col("copies"), by_chance(0)), by_chance(1)]
    open_trees = trees.join(small(stage(several_in, "near-regions")), "region", "left_semi")
    some = open_trees.groupBy("tree", "region", "comp").agg(F.array_distinct(F.array(*[F.min_by(row, x) for x in keys])).alias("x"))
    many = some.select("tree", "comp", F.explode("x").alias("x")).select("tree", "x.prefix", "x.sketch", "x.node", "x.size", "comp")
    more = regions(many, least).select("a", "b").distinct().join(found.select("a", "b"), ["a", "b"], "left_anti")
    comp = merge(comp, links_of(more))
    # What the signatures did not bring together: every pair of what are still different components.
    comp = merge(comp, links_of(left_apart(_with_comp(reps, comp), hundredths, hot)))
    if several:
        known = known.join(small(nodes), "digest", "left").withColumn("node", F.coalesce("node", "rep"))
        low = _with_comp(reps, comp).groupBy("comp").agg(F.min("rep").alias("component_id"))
        comp = _with_comp(reps, comp).select("node", "comp").join(low, "comp").select("node", F.col("component_id").alias("component"))
    else:
        known = known.withColumn("node", F.col("rep"))
    return (
        known.join(comp.withColumnRenamed("component", "component_id") if several else small(comp.withColumnRenamed("component", "component_id")), "node", "left")
        .select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, n: int = 5, hundredths: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so only what is a near duplicate itself goes. Of rows of a group that repeat
    the smallest doc_id one stays: of several texts the one with the least hash, of equal rows any.
    Rows without words or without a doc_id are in no group and all stay.
    """
    spark, key = docs.sparkSession, ["aside_id", "aside_key"]
    with scratch(spark) as kept:
        found = near_duplicates(docs, n, hundredths).filter("n_shingles > 0 and doc_id is not null")
        found = found.select(F.col("doc_id").alias("aside_id"), F.col("text_key").alias("aside_key"), "component_id", "kept")
        groups = found.filter("kept").groupBy("component_id").agg(F.min("aside_key").alias("least"), F.count("*").alias("n")).filter("n > 1")
        groups = stage(groups, "near-groups")
        more = found.filter("kept").join(small(groups), "component_id").filter("aside_key <> least").select(*key)
        gone = stage(found.filter("not kept").select(*key).union(more).distinct(), "near-gone")
        again = stage(groups.join(found.filter("kept"), "component_id").filter("aside_key = least").groupBy(*key).count().filter("count > 1").select(*key), "near-again")
        kept += [gone, again]
    rows = docs.withColumn("aside_id", F.col("doc_id").cast("long")).withColumn("aside_key", F.xxhash64("text"))
    rows = rows.join(small(gone), key, "left_anti")
    if again.limit(1).count():
        rows = rows.join(small(again), key, "left_anti").unionByName(rows.join(small(again), key, "left_semi").dropDuplicates(key))
    return rows.select(*docs.columns)


def _with_comp(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """``sets`` with ``comp``; alone in its component is what ``comp`` does not name."""
    return sets.join(small(comp), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _apart(pairs: DataFrame, comp: DataFrame, ends: str = "node") -> DataFrame:
    """Pairs whose ends are in different components: the pairs, or (``ends="comp"``) the components, each pair once."""
    side = lambda name: comp.select(F.col("node").alias(name), F.col("component").alias(f"comp_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    joined = joined.select("a", "b", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b")).filter("comp_a <> comp_b")
    if ends == "node":
        return joined.select("a", "b")
    return joined.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct()


def merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a staged table): only the graph of components that they join is searched."""
    if not links.limit(1).count():
        return comp
    roots = stage(components(_apart(links, comp, ends="comp")), "near-roots")
    up = small(roots.select(F.col("node").alias("component"), F.col("component").alias("root")))
    moved = comp.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return stage(moved.union(roots), "near-comp")
