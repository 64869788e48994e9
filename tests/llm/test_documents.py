"""Each operator on documents against brute force, on odd cases and on empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import fingerprints, langid, minhash, mixing, packing, quality, scoring, sharding
from millrace.llm.common import binary_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(df):
    return sorted(df.collect(), key=str)


# --- language identification


def test_langid(docs, clashing, rows):
    langs, table = langid.train(docs)
    assert langs == ["de", "en"]
    got = langid.predict(docs, langs, table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in (60, 61, 62, 63):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert all(by[k].lang_pred == ("en" if k % 3 else "de") for k in range(60))
    assert all(0 <= r.score <= 1 for r in got)
    assert by[65].langs == by[66].langs == by[5].langs
    assert collected(langid.predict(clashing, langs, table)) == collected(langid.predict(docs, langs, table))
    assert {"lang_pred", "score", "langs", "size"} <= set(langid.annotate(clashing, langs, table).columns)


def test_langid_finds_mixtures(spark, docs):
    langs, table = langid.train(docs)
    half = {r.doc_id: r.text for r in docs.filter("doc_id < 60").collect()}
    mixed = half[3] + " " + half[4]
    share, _ = langid.infer([mixed, half[3], "", "?"], table)
    n = [len(half[k].split()) for k in (3, 4)]
    assert share[0] == pytest.approx([n[0] / sum(n), n[1] / sum(n)], abs=0.12)
    assert share[1].tolist() == [1.0, 0.0] and not share[2:].any()


def test_langid_mixture_likelihood_grows(docs):
    """The proportions found are at least as likely as a fine grid of others, up to the penalty."""
    langs, table = langid.train(docs)
    text = " ".join(r.text for r in docs.filter("doc_id in (1, 3)").collect())
    buckets, starts, _ = langid.trigrams([text])
    ll = np.add.reduceat(table[buckets].astype(float), starts, axis=0)

    def value(p):
        top = ll.max(1, keepdims=True)
        return float((np.log((np.exp(ll - top) * p).sum(1)) + top[:, 0]).sum())

    share, fit = langid.infer([text], table)
    found = value(share[0])
    assert fit[0] * len(buckets) == pytest.approx(found, rel=1e-3)
    assert found >= max(value(np.array([x, 1 - x])) for x in np.linspace(0.01, 0.99, 99)) - 2 * math.log(len(ll) + 1)


def test_langid_empty(empty, docs):
    langs, table = langid.train(empty)
    assert langs == []
    assert {r.lang_pred for r in langid.predict(docs, langs, table).collect()} == {"und"}
    assert langid.predict(empty, *langid.train(docs)).count() == 0


# --- packing


def test_packing(docs, clashing, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, group_rows=40).collect()
    want = Counter()
    total = 0
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({r.sequence_id for r in packing.pack(docs).collect()}) <= -(-total // 4096) + 1
    assert sorted(map(str, packing.pack(clashing, group_rows=40).collect())) == sorted(map(str, got))


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 200)
    bins, offsets = packing.sum_of_squares(lengths, 100)
    fill: dict[int, int] = {}
    for k in np.argsort(-lengths, kind="stable"):
        s, gaps = int(lengths[k]), Counter(100 - v for v in fill.values() if v < 100)

        def cost(g):
            after = gaps.copy()  # noqa: B023
            after[g] -= 1  # noqa: B023
            if g > s:  # noqa: B023
                after[g - s] += 1  # noqa: B023
            return sum(v * v for v in after.values())

        options = [g for g, n in gaps.items() if n and g >= s]
        gap = 100 - fill.get(int(bins[k]), 0)
        if options:
            assert cost(gap) == min(map(cost, options))
        else:
            assert gap == 100
        assert offsets[k] == fill.get(int(bins[k]), 0)
        fill[int(bins[k])] = fill.get(int(bins[k]), 0) + s
    assert max(fill.values()) <= 100


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a<|ENDOFTEXT|>b.", "İ ΣΑΣ", "x\x1cy z", "don't'll . ,a.b", "é́ naïve!!?", "日本。語", "a\x85b\xa0c"])
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    for x in (text, text * 3, f"plain words first {text}"):
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    e = packing.Encoder(packing.tokenizer_path())
    first = e("one two three, four. five six seven eight nine ten")
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    for _ in range(3):
        assert e("one two three, four. five six seven eight nine ten") == first


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            target.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(docs, clashing, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in target.items():
        assert taken[s] <= t + 1e-6 and t - taken[s] <= max(largest[s], 1)
    assert collected(mixing.mix(clashing.repartition(2))) == collected(mixing.mix(docs))
    rows_of = Counter({r.doc_id: 0 for r in got})
    for r in mixing.mixed(docs).collect():
        rows_of[r.doc_id] += 1
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert {k: v for k, v in rows_of.items() if v} == {k: v for k, v in copies.items() if v}


def test_mixing_shares_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 1}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(brute_targets(sizes))


def test_mixing_empty(empty, spark):
    assert mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(nothing).collect()] == [(0, 0.0), (0, 0.0)]


# --- scoring


def test_scoring_base(docs, rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        if doc_id is not None and doc_id % 7 != 2:
            counts.update([*WORD.findall((text or "").translate(LOWER)), ""])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in scoring.train_and_score(docs, F.expr("doc_id % 7 <> 2")).collect()}
    for doc_id, text, *_ in rows:
        t = [*WORD.findall((text or "").translate(LOWER)), ""]
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.doc_id is not None and r.doc_id % 7 == 2 and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scoring_head_bound_changes_nothing(docs):
    """Counts that are joined and counts that are sent along give the same sums."""
    a, b = ({r.doc_id: r for r in scoring.train_and_score(docs, F.lit(True), head).collect()} for head in (scoring.HEAD, scoring.WORDS + 5))
    assert all((a[k].n_known, a[k].n_tokens) == (b[k].n_known, b[k].n_tokens) for k in a)
    assert all(a[k].base_score == pytest.approx(b[k].base_score) and a[k].score == pytest.approx(b[k].score, rel=1e-4) for k in a)


def test_scoring_does_not_depend_on_partitions(docs, clashing, monkeypatch):
    """The same scores however rows are dealt out, also with several groups."""
    monkeypatch.setattr(scoring, "GROUP", 10_000)
    some = lambda df: Counter((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in scoring.train_and_score(df, F.expr("doc_id % 7 <> 2")).collect())
    want = some(docs)
    assert want == some(docs.repartition(11)) == some(clashing.coalesce(1))


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_places(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2))
    keys = np.concatenate([keys, np.arange(1, 40, dtype=np.uint64) * np.uint64(1 << 20)]) if n > 3 else keys
    other = rng.integers(1, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = scoring.Places(keys)
    assert places(keys).tolist() == list(range(len(keys))) and (places(other) == -1).all()


def test_token_keys():
    keys, stops = scoring.token_keys([b"The the", b"", b"a  b\n"])
    assert stops.tolist() == [3, 4, 7] and keys[0] == keys[1] and (keys[[2, 3, 6]] == scoring.END).all() and len(set(keys.tolist())) == 4


def test_model_is_normalised():
    rng = np.random.default_rng(1)
    m = scoring.Model(rng.normal(0, 1, len(scoring.Model.empty().flat)).astype(np.float32))
    ids = rng.integers(0, scoring.OUTPUTS, 40).astype(np.int32)
    before = scoring.contexts(ids)
    h = (m.context[before] * m.place[:, None]).sum(0)
    energy = h @ m.target.T + m.bias
    want = energy[np.arange(40), ids] - np.log(np.exp(energy).sum(1))
    assert scoring.log_probabilities(m, ids) == pytest.approx(want, abs=1e-3)


def test_contexts_stop_at_ends():
    c = scoring.contexts(np.array([3, 4, 0, 5, 6], dtype=np.int32))
    assert c[0].tolist() == [0, 3, 4, 0, 5] and c[1].tolist() == [0, 0, 3, 0, 0]


def test_gradient():
    """The trainer's step follows the numerical derivative of its loss."""
    rng = np.random.default_rng(2)
    noise = scoring.unigram(rng.integers(1, 50, scoring.OUTPUTS))
    ids = rng.integers(1, scoring.OUTPUTS, 8).astype(np.int32)
    before = scoring.contexts(ids)
    t = scoring.Trainer(scoring.Model.start(noise), noise, 3)
    start = t.m.flat.copy()

    def loss(flat):
        m = scoring.Model(flat)
        x = np.minimum(np.searchsorted(t.cum, np.random.default_rng(3).random(scoring.NOISE)), scoring.OUTPUTS - 1)
        h = (m.context[before].astype(float) * m.place[:, None]).sum(0)
        pos = (h * m.target[ids]).sum(1) + m.bias[ids] - t.log_kq[ids]
        neg = h @ m.target[x].T + m.bias[x] - t.log_kq[x]
        return (np.log1p(np.exp(-pos)).sum() + np.log1p(np.exp(neg)).sum()) / len(ids)

    t.step(ids, before)
    for k in np.argsort(-np.abs(t.grad.flat))[:12]:
        up, down = start.astype(np.float64), start.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(t.grad.flat[k], rel=0.02, abs=1e-5)


def test_scoring_when_executors_come_and_go(spark, docs, monkeypatch):
    """Scans of one table in other layouts, as more or fewer cores give, lose no row and swap no score."""
    df = docs.filter("doc_id is not null").repartition(24)
    known = scoring.WORDS + 5  # most words are joined
    found = lambda: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in scoring.train_and_score(df, F.expr("doc_id % 7 <> 2"), known).collect())
    want, fit, staged = found(), scoring.fit, scoring.stage
    layouts = iter([1, 3, 40, 2, 17] * 9)

    def dealt_anew(f):
        def call(*args):
            spark.conf.set("spark.sql.files.minPartitionNum", str(next(layouts)))
            return f(*args)

        return call

    try:
        for name, f in (("fit", fit), ("stage", staged)):
            monkeypatch.setattr(scoring, name, dealt_anew(f))
        for _ in range(3):
            assert found() == want and sum(want.values()) == df.count()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_scoring_empty(empty, docs):
    assert scoring.train_and_score(empty, F.lit(True)).count() == 0
    rows = scoring.train_and_score(docs.filter("doc_id < 5"), F.lit(False)).collect()
    assert len(rows) == 5 and all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


# --- fingerprints


def brute_signatures(text):
    w = regex.split(r"[^\p{L}\p{N}]+", text.lower())
    c = [(x, i > 0 and w[i - 1] in fingerprints.ANCHORS) for i, x in enumerate(w)]
    c = [z for z in c if z[0] and z[0] not in fingerprints.ANCHORS]
    spots = any(s for _, s in c)
    return sorted({hashlib.md5(" ".join(x for x, _ in c[i : i + 3]).encode()).hexdigest()[:8] for i in range(len(c)) if c[i][1] or not spots})


def jaccard(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("between", [2_000, 7])
def test_fingerprints(docs, clashing, rows, monkeypatch, between):
    monkeypatch.setattr(fingerprints, "ROWS_BETWEEN", between)
    order = sorted(((-(2**63) if i is None else i), t or "", i) for i, t, *_ in rows)
    order = sorted(order, key=lambda x: (-x[0], x[1]))
    want = Counter()
    for k, (_, text, doc_id) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = map(brute_signatures, (text, edited, after))
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), jaccard(a, b), jaccard(a, c)] += 1
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    for df in (docs, clashing):
        assert Counter(tuple(r[c] for c in columns) for r in fingerprints.edit_report(df).collect()) == want


def test_fingerprints_of_one_id_on_many_rows(spark, monkeypatch):
    """A third of the rows have no id: they are dealt to many ranges, in the order of their texts, prefixes and ends of texts included."""
    monkeypatch.setattr(fingerprints, "ROWS_BETWEEN", 40)
    rng = np.random.default_rng(2)
    rows = [(k, f"text {k} of an id") for k in range(2000)] + [(None, "".join(chr(97 + c) for c in rng.integers(0, 3, rng.integers(0, 9)))) for _ in range(1000)]
    rows += [(5, "the same"), (5, "the same long"), (5, ""), (5, None), (5, "ÿ"), (5, "\U0001f600"), (-(2**63), "least")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    order = sorted(((-(2**63) if i is None else i), (t or "").encode(), i) for i, t in rows)
    order = sorted(order, key=lambda x: (-x[0], x[1]))
    want = Counter((order[k][1].decode(), order[(k + 1) % len(order)][1].decode()) for k in range(len(order)))
    found = fingerprints.with_next(df)
    assert Counter((r.text, r.next_text) for r in found.select("text", "next_text").collect()) == want
    hot = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    key, tie = F.lit(-(2**63)), fingerprints._backwards(F.col("text"))
    bounds, n = fingerprints._splitters(hot, key, tie)
    sizes = [r["count"] for r in hot.groupBy(binary_search(bounds, F.struct(key.alias("k"), tie.alias("t")), n, strict=True)).count().collect()]
    assert n > 10 and len(sizes) > 8 and sum(sizes) == 1000 and max(sizes) < 300


def test_near_pairs(docs, rows):
    pairs, members = fingerprints.near_pairs(docs, 0.6)
    sigs = {i: frozenset(brute_signatures(t or "")) for i, t, *_ in rows if i is not None}
    rep = {}
    for i in sorted(sigs):
        rep.setdefault(sigs[i], i)
    assert {r.doc_id: r.rep for r in members.collect()} == {i: rep[s] for i, s in sigs.items()}
    own = sorted((i, s) for s, i in rep.items() if s)
    want = {(a, b): jaccard(x, y) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :] if jaccard(x, y) >= 0.6}
    assert {(r.a, r.b): r.likeness for r in pairs.collect()} == want and want


def test_fingerprints_empty(empty):
    assert fingerprints.edit_report(empty).count() == 0


def test_binary_search(spark):
    bounds = [1, 4, 4, 9]
    df = spark.range(-1, 12).select("id", binary_search(F.array(*map(F.lit, bounds)), F.col("id"), 4).alias("n"))
    assert all(r.n == sum(b <= r.id for b in bounds) for r in df.collect())


# --- near duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark, docs, clashing, rows):
    want, sets = brute_components(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert collected(minhash.near_duplicates(clashing)) == sorted(got, key=str)


def test_near_duplicates_of_families(spark):
    """Families of near copies of many sizes, around the threshold and in one large group, against brute force."""
    import random

    from .conftest import prose

    rng = random.Random(9)
    rows = []
    for family in range(25):
        base = prose(rng, rng.choice([8, 40, 90, 200])).split()
        for _ in range(60 if family == 0 else rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    for parts in (1, 7, 40):
        _same_components(spark, rows, parts)


def test_near_duplicates_of_rows_that_repeat_a_doc_id(spark):
    """Each row by its own text, also where one doc_id has several."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (1, b), (2, b + " more"), (3, c), (None, c), (None, None), (4, None), (4, ""), (3, c + " x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text_key", "component_id", "kept").collect()
    keys = {t: k for t, k in ((r.text, r.k) for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("k")).collect())}
    want = [(0, a, 0), (1, a, 0), (1, b, 1), (1, b, 1), (2, b + " more", 1), (3, c, 3), (None, c, None), (None, None, None), (4, None, 4), (4, "", 4), (3, c + " x", 3)]
    assert Counter((r.doc_id, r.text_key, r.component_id, r.kept) for r in got) == Counter((i, keys[t], k, i is None or i == k) for i, t, k in want)


def test_word_keys():
    """Keys are equal where words are, at every length and place."""
    from millrace.llm.words import LONG, SPAN, word_keys

    texts = [b"a " * 7, b"", b"\x00 \x00\x00 z\x0bz", b"q" * LONG + b" " + b"q" * (LONG + 1), b"w" * (3 * SPAN) + b" z", b"x y " * SPAN, b"q" * (LONG + 1) + b" w w"]
    keys, ends = word_keys(texts)
    words = [w for t in texts for w in t.split()]
    assert ends.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist() and len(keys) == len(words)
    assert len(set(words)) == len(set(keys.tolist())) == len(set(zip(words, keys.tolist(), strict=True)))


def _replaced(words, at, count, rng):
    return words[:at] + [f"y{rng.randrange(10**9)}" for _ in range(count)] + words[at + count :]


def _same_components(spark, rows, parts=7):
    want, _ = brute_components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    return want


def test_near_duplicates_single_links_to_a_large_group(spark, monkeypatch):
    """Documents whose only link leads to one of many variants, far more than stand for their group, none lost."""
    import random

    monkeypatch.setattr(minhash, "WINDOW", 1)
    rng = random.Random(21)
    base = [f"b{k}" for k in range(200)]
    variants = [_replaced(base, rng.randrange(4, 90), 5, rng) for _ in range(400)]
    outside = [_replaced(v, rng.randrange(110, 170), 24, rng) for v in variants[:80]]
    rows = [(k, " ".join(w)) for k, w in enumerate([base, *variants, *outside])]
    assert set(_same_components(spark, rows).values()) == {0}


def test_near_duplicates_below_the_screen(spark):
    """Links whose minima agree less often than the screen asks."""
    import random

    rng, rows = random.Random(23), []
    while len(rows) < 6:
        w = [f"s{rng.randrange(10**9)}" for _ in range(60)]
        pair = [" ".join(w), " ".join(_replaced(w, 20, 4, rng))]
        x, y = (minhash.minima(s) for s in minhash.shingle_sets([t.encode() for t in pair]))
        if (x == y).mean() < 0.6:
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    assert len(set(_same_components(spark, rows, 2).values())) == 3


def test_near_duplicates_across_partitions(spark, monkeypatch):
    """Every row of the sorted trees in a partition of its own, so that each link crosses a boundary."""
    import random

    alone = lambda f: lambda rows, least: f(rows.limit(1), least)
    monkeypatch.setattr(minhash, "neighbours", alone(minhash.neighbours))
    monkeypatch.setattr(minhash, "regions", alone(minhash.regions))
    rng = random.Random(24)
    own = [[f"q{rng.randrange(10**9)}" for _ in range(60)] for _ in range(20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(own + [_replaced(w, 20, 3, rng) for w in own])]
    assert len(set(_same_components(spark, rows).values())) == 20


def test_near_duplicates_of_crowded_regions(spark, monkeypatch):
    """Pairs among documents that share a passage, far more of them than a region is searched for, none lost."""
    import random

    monkeypatch.setattr(minhash, "REGION", 4)
    monkeypatch.setattr(minhash, "WINDOW", 1)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FEW", 4)
    rng = random.Random(22)
    passage = [f"p{k}" for k in range(85)]
    own = [passage + [f"o{rng.randrange(10**9)}" for _ in range(35)] for _ in range(400)]
    rows = [(k, " ".join(w)) for k, w in enumerate(own + [_replaced(w, 95, 12, rng) for w in own[:200]])]
    assert len(set(_same_components(spark, rows).values())) == 400


def test_near_duplicates_of_hot_shingles(spark, monkeypatch):
    """Shingles that half of all documents hold are dealt out before their holders meet, and lose no link: no task gets more of one than a block."""
    import random

    monkeypatch.setattr(minhash, "WINDOW", 1)
    monkeypatch.setattr(minhash, "REGION", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HOT", 40)
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(85)]
    own = [passage + [f"o{rng.randrange(10**9)}" for _ in range(35)] for _ in range(150)]
    rows = [(k, " ".join(w)) for k, w in enumerate(own + [_replaced(w, 95, 12, rng) for w in own[:70]] + [[f"x{k}-{j}" for j in range(30)] for k in range(100)])]
    dealt, holders = [], minhash.hot_holders

    def seen(sets, hot):
        dealt.append(len(hot))
        return holders(sets, hot)

    monkeypatch.setattr(minhash, "hot_holders", seen)
    assert len(set(_same_components(spark, rows).values())) == 250
    assert dealt and dealt[0] >= 70


def test_holders_of_hot_shingles(spark):
    sets = [(k, k % 3, 10, np.array([5, 9, 100 + k] if k % 2 else [9, 7], dtype=np.uint64).tobytes()) for k in range(60)] + [(100, 9, 10, np.array([77], dtype=np.uint64).tobytes())]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in sets], "node long, comp long, size long, prefix binary").repartition(4)
    got = minhash.hot_holders(df, np.array([5, 7, 9, 77, 1000], dtype=np.uint64)).collect()
    want = Counter((int(t), node, comp, pos) for node, comp, _, raw in sets for pos, t in enumerate(np.frombuffer(raw, np.uint64)) if t in (5, 7, 9))
    assert Counter((r.token, r.node, r.comp, r.pos) for r in got) == want and {r.blocks for r in got} == {1}
    assert minhash.hot_holders(df, np.array([1000], dtype=np.uint64)).count() == 0


def test_near_duplicates_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    import random

    rng = random.Random(4)
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    some = [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(120)]
    edges = path + star + some
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent) if find(x) != x}


# --- sharding


def test_sharding(docs, clashing, rows):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert collected(sharding.shard(clashing)) == sorted(got, key=str)


def test_sharding_balances(spark):
    import random

    rng = random.Random(5)
    rows = [(k, "".join(rng.choices("abcdef ", k=rng.randint(10, 3000)))) for k in range(3000)]
    rows += [(5000 + k, "hot " * 30) for k in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(sums) == 8 and max(sums.values()) < 1.03 * min(sums.values())


@pytest.mark.parametrize(("of_a_shard", "homes"), [(0.4, 1), (0.6, 1), (0.95, 1), (1.5, None), (2.7, None)])
def test_sharding_keeps_a_text_together_that_fits(spark, of_a_shard, homes):
    """A hot text of each size, with unique, repeated and null ids: together if a shard can hold it, else divided; sizes near equal."""
    import random

    rng, hot = random.Random(7), "hot text " * 11
    rows = [(k, "".join(rng.choices("abcdef ", k=rng.randint(10, 300)))) for k in range(4000)]
    other = sum(len(t) + 1 for _, t in rows)
    n = round(of_a_shard * other / (8 - of_a_shard) / (len(hot) + 1))
    rows += [(9000 + k if k % 3 == 0 else 5 if k % 3 == 1 else None, hot) for k in range(n)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sums, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(sums) == 8 and max(sums.values()) < 1.04 * min(sums.values())
    crc = zlib.crc32(hot.encode())
    assert all(len(x) == 1 for k, x in where.items() if k != crc) and (len(where[crc]) == homes or homes is None)


def test_sharding_subdivides_until_no_range_is_overfull(spark, monkeypatch):
    """With a poor sample the first ranges are far too large."""
    import random

    rng = random.Random(8)
    rows = sharding.stage(sharding.record_columns(spark.createDataFrame([(k, "x" * rng.choice([1, 5, 4000]) + str(k)) for k in range(3000)], "doc_id long, text string")), "t")
    total = rows.agg(F.sum("size")).first()[0]
    _, sums = sharding.splitters(rows, 400, total, 1, 3)
    assert ((sums["s"] <= 2 * total / 400) | (sums["lo"] == sums["hi"])).all() and sums["s"].sum() == total


def test_sharding_empty_and_files(spark, empty, docs, tmp_path):
    assert sharding.shard(empty).count() == 0
    some = docs.filter("doc_id < 60")
    placed = sharding.write_shards(some, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}


# --- quality


def brute_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_counts(docs, clashing, rows):
    got = quality.statistics(docs).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality.BASE]) for r in got) == Counter((i, *brute_counts(t)) for i, t, *_ in rows)
    assert collected(quality.statistics(clashing)) == sorted(got, key=str)


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a b c d e f", "x " * 7, "l1 w\nl1 w\n \n \nl1 w ", "é ß\n日 本", "a\x0bb\x1cc\x85d"])
def test_quality_counts_of(text):
    assert quality.text_counts(text.encode())[:5] == brute_counts(text)


def test_quality_learns(spark, docs):
    bad = [(1000 + k, f"BUY!! NOW!! {k} CHEAP!! $$$ ### OFFER!! CALL!! ME!! TODAY!! WIN!! BIG!! {k}") for k in range(60)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(bad, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(1000 + k, 0) for k in range(40)] + [(5, None), (99999, 0), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(all_docs, labels).collect()}
    assert not any(got[1000 + k].kept for k in range(60))
    assert all(got[k].kept for k in range(60))
    assert all(not r.kept for r in got.values() if r.base_failed)
    assert got[61].base_failed and got[60].n_words == 0
    none = quality.quality(all_docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_quality_empty(empty, spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.quality(empty, labels).count() == 0


def test_rules_are_one_case(spark):
    rules = [quality.Rule((("upper", ">=", 0.5),), 1, 1), quality.Rule((("n_words", "<=", 5.0), ("distinct", ">=", 0.1)), 1, 1)]
    assert "CASE WHEN" in str(quality.verdict(rules)) and str(quality.verdict([])) == str(F.lit(0))


def test_packing_deals_equal_rows_apart(spark):
    """As many rows with no id and one text as others: no group gets more of them."""
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    df = same.union(spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")))).repartition(6)
    got = packing.pack(df, group_rows=500).groupBy(F.shiftright("sequence_id", 32).alias("grp")).agg(F.count("*").alias("n")).collect()
    sizes = sorted(r.n for r in got)
    assert sum(sizes) == 6000 and len(sizes) == 12 and sizes[-1] <= 1.5 * 500
    # the numbers that tell them apart are the same however a task gets its rows
    own = lambda df: Counter(packing.pieces(df.coalesce(1)).select("doc_id", "again").collect())
    assert own(df) == own(df.orderBy(F.rand(3)))


def test_quality_samples_documents_not_rows(spark):
    """One id on thousands of rows is one row of the sample, and the bound holds for ids too."""
    docs = spark.range(3000).select((F.col("id") - 2900).alias("k")).select(F.greatest("k", F.lit(0)).alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "k").alias("text")).repartition(5)
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = quality.labelled_sample(docs, labels)
    assert len(got) == 100 and int(got["bad"].sum()) == 50
    assert len(quality.labelled_sample(docs, labels, sample_rows=20)) <= 20
    assert quality.labelled_sample(docs.orderBy(F.rand(1)), labels).equals(got)
