"""The service's queue as keyed streaming state: guarded claims, and a purge that is a timer.

Rows are dealt to a fixed number of buckets by a hash of their id, and a bucket is one key: its rows come to Python and go back to the state store
together, so that a micro-batch costs a call for each bucket and not one for each row. The update is guarded where it happens: of two claims of a row the second loses, and a worker that held a row for too
long finds that its answer is refused. State, timers and output are committed together by the checkpoint, so a restarted query repeats nothing.

An event is ``id, at, seq, action, worker``: ``submit`` queues a new or completed row, ``claim`` runs a queued one,
``finish`` completes one that the same worker runs. A row that runs for ``limit`` is queued again, at that moment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.service import COMPLETE, QUEUED, RUNNING
from ..sources.shared import settings
from .worker import answer

EVENTS = "id long, at timestamp, seq long, action string, worker string"
#: Times are microseconds inside, so that no time zone lies between events, timers and the watermark.
INSIDE = "id long, us long, seq long, action string, worker string, outcome string, state int"
#: State of a bucket: its rows, column by column.
HELD = "ids array<long>, states array<int>, workers array<string>, since array<long>"
#: Fixed value: buckets of a queue. A checkpoint holds for one number.
BUCKETS = 4096
#: The provider that keeps state on disk, not in the memory of executors.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Sequence number of an answer: it comes after all else of its moment.
LAST = (1 << 63) - 1

State = tuple[int, str, int]
Row = tuple[int, int | None, str, str, str, int]


def expired(now: State | None, at: int, limit: int) -> tuple[State | None, Row | None]:
    """The state at ``at``, and what happened if a run went on for too long before."""
    if now is None or now[0] != RUNNING or at < now[2] + limit:
        return now, None
    due = now[2] + limit
    return (QUEUED, "", due), (due, None, "purge", now[1], "queued again", QUEUED)


def step(now: State | None, at: int, seq: int | None, action: str, worker: str) -> tuple[State | None, Row]:
    """The state after an event, and its outcome. The guards are here: nothing else writes a row's state."""
    state = -1 if now is None else now[0]
    if action == "submit" and state in (-1, COMPLETE):
        now, outcome = (QUEUED, "", at), "queued"
    elif action == "claim" and state == QUEUED:
        now, outcome = (RUNNING, worker, at), "won"
    elif action == "finish" and state == RUNNING and now[1] == worker:
        now, outcome = (COMPLETE, "", at), "complete"
    else:
        outcome = {"submit": "known", "claim": "lost", "finish": "refused"}[action]
    return now, (at, seq, action, worker, outcome, -1 if now is None else now[0])


class Queue:
    """The rows of one bucket, ``limit`` microseconds being the longest run; called once for each bucket of a micro-batch, and when its earliest run ends."""

    def __init__(self, limit: int):
        self.limit = limit

    def _due(self, state: State) -> int:
        """Milliseconds from which on the clock ends a run."""
        return -(-(state[2] + self.limit) // 1000)

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ids, states, workers, since = held.get if held.exists else ([], [], [], [])
        rows: dict[int, State] = dict(zip(ids, zip(states, workers, since, strict=True), strict=True))
        out: list[tuple] = []
        events = [] if held.hasTimedOut else list(frames)
        if events:
            some = pd.concat(events).sort_values(["us", "bare", "seq"])  # those of one row keep this order
            for id_, us, bare, seq, action, worker in zip(*(some[c].tolist() for c in ("id", "us", "bare", "seq", "action", "worker")), strict=True):
                now, purged = expired(rows.get(id_), us, self.limit)
                now, done = step(now, us, None if bare else seq, action, worker)
                if now is not None:
                    rows[id_] = now
                out += [(id_, *purged), (id_, *done)] if purged else [(id_, *done)]
        clock = held.getCurrentWatermarkMs()
        for id_, state in rows.items():
            if state[0] == RUNNING and self._due(state) <= clock:
                rows[id_], purged = expired(state, clock * 1000, self.limit)
                out.append((id_, *purged))
        held.update((list(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()], [r[2] for r in rows.values()]))
        first = min((self._due(r) for r in rows.values() if r[0] == RUNNING), default=None)
        if first is not None:
            held.setTimeoutTimestamp(first - 1)  # fires once the clock is beyond
        if out:
            frame = pd.DataFrame(out, columns=["id", "us", "seq", "action", "worker", "outcome", "state"])
            yield frame.assign(seq=pd.array([r[2] for r in out], "Int64"))


def outcomes(events: DataFrame, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """What becomes of a stream of ``EVENTS``, purges among them: ``id, at, seq, action, worker, outcome, state`` (after it; -1 for an unknown row).

    Events of a row are taken in the order of ``at, seq`` within a micro-batch, and micro-batches as they come; events later than ``late``
    behind the newest are left out by the watermark, which is also the clock of purges. An action other than the three, or a null id or time, is left out.
    """
    known = events.filter("id is not null and at is not null and action in ('submit', 'claim', 'finish')")
    rows = known.select(
        "id", "at", F.unix_micros("at").alias("us"), F.col("seq").isNull().alias("bare"), F.coalesce("seq", F.lit(0)).alias("seq"), "action", F.coalesce("worker", F.lit("")).alias("worker"),
        F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"),
    ).withWatermark("at", late)
    found = rows.groupBy("bucket").applyInPandasWithState(Queue(limit_seconds * 1_000_000), INSIDE, HELD, "append", "EventTimeTimeout")
    return found.select("id", F.timestamp_micros("us").alias("at"), "seq", "action", "worker", "outcome", "state")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, limit_seconds: int, late: str = "1 hour", files: int = 1000, once: bool = True) -> StreamingQuery:
    """Follow a folder of ``EVENTS`` and append what becomes of them to the dataset ``output``, each once, restarts included.

    The file sink commits a batch's files by its log, and state by the same batch number: what a stopped run has not committed is done again.
    """
    sink = outcomes(_events(spark, source, files), limit_seconds, late).writeStream.format("parquet").outputMode("append").option("path", output)
    return _started(spark, sink, checkpoint, once)


def _events(spark: SparkSession, source: str, files: int) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(source)


def _started(spark: SparkSession, sink: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    with settings(spark, STORE):  # a query keeps the settings that it started with
        writer = sink.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def serve(spark: SparkSession, folder: str, limit_seconds: int, infer: Callable[[pd.Series], pd.Series] | None = None, late: str = "1 hour", files: int = 1000, once: bool = True) -> StreamingQuery:
    """The worker's whole round: a claim that wins is answered, and the answer is an event that completes its row.

    ``folder`` has ``events`` (``EVENTS``) and ``requests`` (``id, input``). Outcomes and answers of a micro-batch are folders named by its number, written
    over if it is done again; its answers go to ``events`` as ``finish`` at the newest time of the batch, so they are never late, and are read with
    the next batch. An answer to a row that was purged meanwhile is refused like any other. ``once`` follows what is there; :func:`drain` goes on until all is answered.
    """
    stream = outcomes(_events(spark, f"{folder}/events", files), limit_seconds, late)

    def store(batch: DataFrame, number: int) -> None:
        done = f"{folder}/outcomes/batch={number}"
        batch.write.mode("overwrite").parquet(done)  # state moves once: what follows reads what was written
        found = spark.read.schema(batch.schema).parquet(done)
        newest = found.filter("action <> 'purge'").agg(F.max("at")).first()[0]
        # a run that a later event of this batch ended is not answered
        held = found.filter("outcome not in ('known', 'lost', 'refused')")
        last = held.groupBy("id").agg(F.max_by(F.struct("outcome", "worker", "at"), F.struct("at", F.coalesce("seq", F.lit(-(1 << 63))))).alias("l"))
        won = last.filter("l.outcome = 'won'").select("id", "l.worker", F.col("l.at").alias("since"))
        rows = spark.read.parquet(f"{folder}/requests").join(won, "id").withColumn("state", F.lit(QUEUED))
        answer(rows, infer).select("id", "worker", "since", "output").write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
        answers = spark.read.parquet(f"{folder}/answers/batch={number}")
        events = answers.select("id", F.lit(newest).cast("timestamp").alias("at"), F.lit(LAST).alias("seq"), F.lit("finish").alias("action"), "worker")
        events.write.mode("overwrite").parquet(f"{folder}/events/answers-{number}")

    return _started(spark, stream.writeStream.foreachBatch(store).outputMode("append"), f"{folder}/checkpoint", once)


def drain(spark: SparkSession, folder: str, limit_seconds: int, infer: Callable[[pd.Series], pd.Series] | None = None, **options: str | int) -> DataFrame:
    """Serve until no answer is left to bring back: ``id, state, worker, output`` of all rows."""
    while True:
        query = serve(spark, folder, limit_seconds, infer, **options)
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    # an answer counts if the row is complete: of several the one by the worker that completed it
    found = spark.read.option("basePath", f"{folder}/outcomes").parquet(f"{folder}/outcomes").drop("batch")
    finished = found.filter("outcome = 'complete'").groupBy("id").agg(F.max_by("worker", "at").alias("by"))
    answers = spark.read.parquet(f"{folder}/answers").groupBy("id", F.col("worker").alias("by")).agg(F.max_by("output", "since").alias("output"))
    return states(found).join(finished.join(answers, ["id", "by"]).drop("by"), "id", "left").select("id", "state", "worker", F.when(F.col("state") == COMPLETE, F.col("output")).alias("output"))


def states(outcome: DataFrame) -> DataFrame:
    """``id, state, worker`` as it stands after all outcomes: the last that changed a row, found in each task first."""
    changed = outcome.filter("outcome not in ('known', 'lost', 'refused')")
    last = F.max_by(F.struct("state", "worker"), F.struct("at", F.coalesce("seq", F.lit(-(1 << 63)))))  # a purge comes before what happens at its moment
    return changed.groupBy("id").agg(last.alias("l")).select("id", "l.state", F.when(F.col("l.state") == RUNNING, F.col("l.worker")).alias("worker"))
