"""The queue as keyed streaming state: guards, timers, and restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import queue

START = datetime(2024, 3, 1)
HOUR = 3600 * 1_000_000


def events(n=400, rows=12, seed=5):
    rng = random.Random(seed)
    at, out = 0, []
    for k in range(n):
        at += rng.randint(1, 40 * 60_000_000)
        out.append((rng.randrange(rows), START + timedelta(microseconds=at), k, rng.choice(["submit", "claim", "claim", "finish", "drop"]), f"w{rng.randrange(2)}"))
    return out


def replayed(some, limit, upto):
    """One row after another, in plain Python."""
    micros = lambda t: (t - START) // timedelta(microseconds=1)
    state, out = {}, []
    for key, at, seq, action, worker in some:
        if action == "drop":
            continue
        was, who, since = state.get(key, (None, None, 0))
        if was == 1 and micros(at) >= since + limit:
            out.append((key, since + limit, None, "purge", who, "queued again", 0))
            was, who, since = 0, "", since + limit
        if action == "submit":
            result = "queued" if was in (None, 2) else "known"
        elif action == "claim":
            result = "won" if was == 0 else "lost"
        else:
            result = "complete" if was == 1 and who == worker else "refused"
        now = {"queued": (0, "", micros(at)), "won": (1, worker, micros(at)), "complete": (2, "", micros(at))}.get(result, (was, who, since))
        if now[0] is not None:
            state[key] = now
        out.append((key, micros(at), seq, action, worker, result, -1 if now[0] is None else now[0]))
    for key, (was, who, since) in state.items():
        if was == 1 and since + limit <= micros(upto):
            out.append((key, since + limit, None, "purge", who, "queued again", 0))
    return sorted(out, key=str)


def collected(spark, path):
    micros = lambda t: (t - START) // timedelta(microseconds=1)
    rows = spark.read.parquet(path).selectExpr("id", "cast(at as timestamp_ntz) as at", "seq", "action", "worker", "outcome", "state").collect()
    return sorted(((r.id, micros(r.at), r.seq, r.action, r.worker, r.outcome, r.state) for r in rows), key=str)


def put(spark, path, some):
    spark.createDataFrame(some, "id long, at timestamp_ntz, seq long, action string, worker string").selectExpr("id", "cast(at as timestamp) as at", "seq", "action", "worker").coalesce(1).write.mode("append").parquet(path)


def test_two_claims_of_one_row(spark, tmp_path):
    t = lambda h: START + timedelta(hours=h)
    some = [
        (1, t(0), 0, "submit", None), (1, t(1), 1, "claim", "a"), (1, t(1), 2, "claim", "b"), (1, t(2), 3, "finish", "b"), (1, t(3), 4, "finish", "a"), (1, t(4), 5, "claim", "b"),
        (2, t(0), 6, "claim", "a"), (2, t(1), 7, "submit", "c"), (2, t(2), 8, "claim", "a"), (2, t(30), 9, "finish", "a"), (3, t(1), 10, "submit", "c"), (3, t(2), 11, "claim", "a"), (4, t(60), 12, "submit", "c"),
        (None, t(1), 13, "submit", "c"), (5, None, 14, "submit", "c"), (5, t(1), 15, None, "c"),
    ]
    put(spark, f"{tmp_path}/in", some)
    queue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", 10 * 3600).awaitTermination()
    got = {(r[0], r[2]): r[5] for r in collected(spark, f"{tmp_path}/out")}
    assert [got[1, k] for k in range(6)] == ["queued", "won", "lost", "refused", "complete", "lost"]
    # the second ran for too long: it was queued again, and its late answer is refused; the third by the clock alone
    assert [got[2, k] for k in (6, 7, 8, None, 9)] == ["lost", "queued", "won", "queued again", "refused"] and got[3, None] == "queued again"
    states = {r.id: (r.state, r.worker) for r in queue.states(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert states == {1: (2, None), 2: (0, None), 3: (0, None), 4: (0, None)}


def test_restarts_repeat_nothing(spark, tmp_path):
    """Stopped after some files and started again on the same checkpoint, twice: every outcome once, as if in one go."""
    some = events()
    limit, upto = 5 * HOUR, some[-1][1] - timedelta(hours=1)
    source, output, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for k in range(4):
        put(spark, source, some[k * 100 : k * 100 + 100])
        query = queue.run(spark, source, output, checkpoint, 5 * 3600, files=1, once=k != 1)
        if k == 1:  # stopped whatever it is doing
            while not query.recentProgress and query.isActive:
                query.awaitTermination(0.2)
            query.stop()
        else:
            query.awaitTermination()
    assert collected(spark, output) == replayed(some, limit, upto)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != queue.STORE["spark.sql.streaming.stateStore.providerClass"]


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_time_zones_do_not_matter(spark, tmp_path, zone):
    some = events(120)
    before = spark.conf.get("spark.sql.session.timeZone")
    put(spark, f"{tmp_path}/in", some)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        queue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", 5 * 3600).awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert collected(spark, f"{tmp_path}/out") == replayed(some, 5 * HOUR, some[-1][1] - timedelta(hours=1))


def test_rows_share_the_keys_of_the_state(spark, tmp_path):
    """A batch of many rows costs a call for each bucket, and rows of one bucket do not see each other; some events have no number."""
    some = events(12000, rows=9000, seed=7)
    some = [(key, at, None if key % 3 == 0 else queue.LAST - k, action, worker) for key, at, k, action, worker in some]
    put(spark, f"{tmp_path}/in", some)
    query = queue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", 5 * 3600)
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= queue.BUCKETS < len({r[0] for r in some if r[3] != "drop"})
    assert collected(spark, f"{tmp_path}/out") == replayed(some, 5 * HOUR, some[-1][1] - timedelta(hours=1))


def test_answers_come_back_to_the_queue(spark, tmp_path):
    """Requests are claimed, answered and completed in one flow, failures of the model included; another run changes nothing."""
    import pandas as pd

    t = lambda m: START + timedelta(minutes=m)
    spark.createDataFrame([(k, f" Ask  {k} ") for k in range(12)], "id long, input string").write.parquet(f"{tmp_path}/requests")
    some = [(k, t(k), k, "submit", None) for k in range(12)] + [(k, t(20 + k), 100 + k, "claim", f"w{k % 2}") for k in range(10)]
    put(spark, f"{tmp_path}/events", some + [(1, t(40), 300, "claim", "w9")])

    def infer(values):
        if values.str.contains("7").any():
            raise ValueError("seven")
        return pd.Series("re: " + values)

    want = {k: (2, f"re: ask {k}" if k != 7 else "ValueError: seven") for k in range(10)} | {k: (0, None) for k in (10, 11)}
    for _ in range(2):
        found = {r.id: (r.state, r.output) for r in queue.drain(spark, f"file://{tmp_path}", 3600, infer).collect()}
        assert found == want
    put(spark, f"{tmp_path}/events", [(10, t(50), 400, "claim", "w1"), (0, t(51), 401, "submit", None), (0, t(52), 402, "claim", "w1")])
    found = {r.id: (r.state, r.output) for r in queue.drain(spark, f"file://{tmp_path}", 3600, infer).collect()}
    assert found == want | {10: (2, "re: ask 10")}
