"""Queries of the inference service: reports, the queue, feedback, and the streaming worker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import service
from ..sources import jdbc
from ..sources.shared import new_path, staged
from ..sources.tables import Tables
from ..streaming import queue, worker
from . import fixtures as fx
from .fixtures import table


def user_report(spark, sf):
    pending = fx.completions(spark, sf).filter("state = 1")
    return service.user_report(fx.users(spark, sf), pending)


def user_report_sorted(spark, sf):
    return service.user_report(fx.users(spark, sf), fx.completions(spark, sf)).orderBy(F.col("completions").desc(), "username").limit(25)


def completion_list(spark, sf):
    return service.list_completions(fx.completions(spark, sf), fx.users(spark, sf))


def completion_search(spark, sf):
    return service.list_completions(fx.completions(spark, sf), fx.users(spark, sf), limit=50, date="1998-10-03", pattern="Low")


def completion_export(spark, sf):
    return service.export(fx.completions(spark, sf), fx.users(spark, sf), "1997-01-01")


def completion_serialize(spark, sf):
    return service.serialize(service.with_users(fx.completions(spark, sf), fx.users(spark, sf)))


def visible_completions(spark, sf):
    return service.visible(fx.queue(spark, sf), 8).select("id", "state")


def queue_next(spark, sf):
    return service.next_queued(fx.queue(spark, sf)).select("id", "timestamp")


def queue_claim(spark, sf):
    return service.claim(fx.queue(spark, sf), 5).select("id", "state")


def queue_purge(spark, sf):
    return service.purge(fx.queue(spark, sf)).select("id", "state")


def queue_running(spark, sf):
    return service.running(fx.queue(spark, sf))


def queue_pending(spark, sf):
    return service.pending(fx.queue(spark, sf))


def queue_complete(spark, sf):
    results = fx.queue(spark, sf).filter("state = 1").select("id", F.concat(F.lit("out "), "id").alias("output"))
    return service.complete(fx.queue(spark, sf), results).select("id", "state", "output")


def queue_insert(spark, sf):
    new = table(spark, sf, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("id"), F.col("item_id").alias("user_id"), F.lit(0).alias("type"), F.col("text").alias("input"),
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
    )
    return service.insert(fx.queue(spark, sf), new).select("id", "state", "input")


def queue_delete(spark, sf):
    return service.delete(fx.queue(spark, sf), 0, 8).select("id")


def feedback_upsert(spark, sf):
    patch = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 5 - F.col("toxic")).alias("rating"), F.lit("seen").alias("comments"))
    return service.upsert_feedback(fx.queue(spark, sf), patch).select("id", "rating", "comments")


def users_admin(spark, sf):
    return service.set_admin(fx.users(spark, sf), "Customer#000000001").filter("admin").select("id", "username")


def users_get_or_create(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("username")).union(table(spark, sf, "customer").select("c_name"))
    return service.get_or_create(fx.users(spark, sf), names).select("id", "username")


def stream_worker(spark, sf):
    """Queued events as files, answered by a stream until none is left."""
    folder = new_path(spark, "worker")
    requests = fx.queue(spark, sf).select("id", "user_id", "input", "timestamp", "state")
    requests.write.mode("overwrite").parquet(f"{folder}/in")
    stream = worker.work(spark, f"{folder}/in", requests.schema.simpleString()[7:-1].replace(":", " "), f"{folder}/out", f"{folder}/checkpoint")
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "state", "output")


def _replayed(spark, sf):
    """The events of the queue as files, followed by a stream until none is left."""
    folder = new_path(spark, "queue")
    fx.queue_events(spark, sf).write.parquet(f"{folder}/in")
    queue.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", RUN_HOURS * 3600).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def queue_outcomes(spark, sf):
    return _replayed(spark, sf).withColumn("happened", F.col("at").cast("timestamp_ntz")).drop("at")


def queue_states(spark, sf):
    return queue.states(_replayed(spark, sf))


def service_tables(spark, sf):
    """The service's tables in a database: written, then scanned in ranges of their keys, with filters that the database applies.

    A cluster for which no database is named keeps them as files in its shared folder, in ranges of their keys too, with filters that the scan applies.
    """
    completions, users = fx.completions(spark, sf).select("id", "user_id", "state", "input", "timestamp", "rating"), fx.users(spark, sf)
    if jdbc.reachable(spark):
        url = jdbc.database(spark, f"service_{uuid.uuid4().hex}")
        jdbc.write_table(completions, url, "completion", 4)
        jdbc.write_table(users, url, "service_user", 4)
        completions, users = jdbc.read_table(spark, url, "completion", "id", 4), jdbc.read_table(spark, url, "service_user", "id", 2)
    else:
        completions, users = (staged(rows.repartitionByRange("id"), name) for rows, name in ((completions, "completion"), (users, "service_user")))
    open_rows = completions.filter("state <> 2 and rating >= 1")
    users = users.filter("admin").select(F.col("id").alias("user_id"), "username")
    return open_rows.join(users, "user_id").select("id", "username", "state", "input", "timestamp", "rating")


def _tables(spark, sf):
    """The service's tables, created, filled and purged."""
    tables = Tables(spark, new_path(spark, "service"))
    tables.initialize(buckets=8)
    tables.replace("user", fx.users(spark, sf))
    tables.replace("completion", fx.completions(spark, sf))
    tables.replace("completion", service.purge(tables.table("completion")))
    return tables


def table_report(spark, sf):
    tables = _tables(spark, sf)
    return service.user_report(tables.table("user"), tables.table("completion"))


def table_join(spark, sf):
    tables = _tables(spark, sf)
    return service.with_users(tables.table("completion"), tables.table("user")).select("id", "username", "state", "timestamp")


def queue_served(spark, sf):
    """Requests claimed by three workers, answered by the stream, and completed by their answers."""
    folder = new_path(spark, "served")
    asked = fx.queue(spark, sf).filter("state = 0")
    asked.select("id", "input").write.parquet(f"{folder}/requests")
    event = lambda action, second, worker: F.struct(F.expr(f"cast(timestamp as timestamp) + interval {second} second").alias("at"), F.lit(action).alias("action"), worker.alias("worker"))
    submit, claim = event("submit", 0, F.lit(None).cast("string")), event("claim", 1, F.concat(F.lit("w"), F.col("id") % 3))
    events = asked.select("id", F.col("id").alias("seq"), F.explode(F.array(submit, claim)).alias("e")).select("id", "e.at", "seq", "e.action", "e.worker")
    events.write.parquet(f"{folder}/events")
    return queue.drain(spark, folder, 10**8).select("id", "state", "output")


#: Hours that a claimed row may run before it is queued again.
RUN_HOURS = 12

#: The events of all rows step by step, each guarded by the state before it; runs that end later than the watermark are still running.
OUTCOMES_SQL = f"""
WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY happened, seq) AS r FROM ({fx.QUEUE_EVENTS})),
steps AS (
  SELECT id, CAST(0 AS BIGINT) AS r, -1 AS state, '' AS holder, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS due, '' AS loser, CAST('' AS VARCHAR) AS outcome
  FROM (SELECT DISTINCT id FROM ev)
  UNION ALL
  SELECT id, r,
         CASE outcome WHEN 'queued' THEN 0 WHEN 'won' THEN 1 WHEN 'complete' THEN 2 ELSE was END,
         CASE outcome WHEN 'won' THEN worker WHEN 'queued' THEN '' WHEN 'complete' THEN '' ELSE held END,
         CASE WHEN outcome IN ('queued', 'won', 'complete') THEN happened ELSE begun END, ended, CASE WHEN ended IS NOT NULL THEN holder ELSE '' END, outcome
  FROM (SELECT *, CASE WHEN action = 'submit' THEN CASE WHEN was IN (-1, 2) THEN 'queued' ELSE 'known' END
                       WHEN action = 'claim' THEN CASE WHEN was = 0 THEN 'won' ELSE 'lost' END
                       ELSE CASE WHEN was = 1 AND held = worker THEN 'complete' ELSE 'refused' END END AS outcome
        FROM (SELECT e.id, e.r, e.happened, e.action, e.worker, s.holder, CASE WHEN spent THEN 0 ELSE s.state END AS was, CASE WHEN spent THEN '' ELSE s.holder END AS held,
                     CASE WHEN spent THEN s.since + INTERVAL {RUN_HOURS} HOUR ELSE s.since END AS begun, CASE WHEN spent THEN s.since + INTERVAL {RUN_HOURS} HOUR END AS ended
              FROM (SELECT *, r + 1 AS next FROM steps) s JOIN ev e ON e.id = s.id AND e.r = s.next,
                   LATERAL (SELECT s.state = 1 AND e.happened >= s.since + INTERVAL {RUN_HOURS} HOUR AS spent)))),
last AS (SELECT * FROM steps s WHERE r = (SELECT max(r) FROM ev e WHERE e.id = s.id)),
found AS (
  SELECT e.id, e.happened, e.seq, e.action, e.worker, s.outcome, s.state FROM steps s JOIN ev e ON e.id = s.id AND e.r = s.r
  UNION ALL
  SELECT id, due, NULL, 'purge', loser, 'queued again', 0 FROM steps WHERE due IS NOT NULL
  UNION ALL
  SELECT id, since + INTERVAL {RUN_HOURS} HOUR, NULL, 'purge', holder, 'queued again', 0 FROM last
  WHERE state = 1 AND since + INTERVAL {RUN_HOURS} HOUR <= (SELECT max(happened) - INTERVAL 1 HOUR FROM ev))
"""

QUERIES = {
    "queue_outcomes": (queue_outcomes, f"{OUTCOMES_SQL} SELECT * FROM found"),
    "service_tables": (
        service_tables,
        f"""SELECT c.id, u.username, c.state, c.input, c.timestamp, c.rating FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id
            WHERE u.admin AND c.state <> 2 AND c.rating >= 1""",
    ),
    "table_report": (
        table_report,
        f"""SELECT u.username, u.admin, count(c.id) AS completions, CAST(coalesce(sum(CASE WHEN c.rating IS NOT NULL OR c.comments IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS feedback
            FROM ({fx.USERS}) u LEFT JOIN ({fx.COMPLETIONS}) c ON c.user_id = u.id GROUP BY u.id, u.username, u.admin""",
    ),
    "table_join": (
        table_join,
        f"""SELECT c.id, u.username, CASE WHEN c.state = 1 THEN 0 ELSE c.state END AS state, c.timestamp FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id""",
    ),
    "queue_served": (
        queue_served,
        rf"""SELECT id, 2 AS state, regexp_replace(lower(regexp_replace(regexp_replace(input, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g') AS output
            FROM ({fx.QUEUE}) WHERE state = 0""",
    ),
    "queue_states": (
        queue_states,
        f"""{OUTCOMES_SQL} SELECT id, state, CASE WHEN state = 1 THEN worker END AS worker
            FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY happened DESC, seq DESC NULLS LAST) AS k FROM found WHERE outcome NOT IN ('known', 'lost', 'refused')) WHERE k = 1""",
    ),
    "user_report": (
        user_report,
        f"""SELECT u.username, u.admin, count(c.id) AS completions, CAST(coalesce(sum(CASE WHEN c.rating IS NOT NULL OR c.comments IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS feedback
            FROM ({fx.USERS}) u LEFT JOIN (SELECT * FROM ({fx.COMPLETIONS}) WHERE state = 1) c ON c.user_id = u.id GROUP BY u.id, u.username, u.admin""",
    ),
    "user_report_sorted": (
        user_report_sorted,
        f"""SELECT u.username, u.admin, count(c.id) AS completions, CAST(coalesce(sum(CASE WHEN c.rating IS NOT NULL OR c.comments IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS feedback
            FROM ({fx.USERS}) u LEFT JOIN ({fx.COMPLETIONS}) c ON c.user_id = u.id GROUP BY u.id, u.username, u.admin ORDER BY completions DESC, u.username LIMIT 25""",
    ),
    "completion_list": (
        completion_list,
        f"""SELECT u.username, c.id, c.timestamp, ['queued', 'running', 'complete'][c.state + 1] AS state, c.input
            FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id ORDER BY c.timestamp, c.id LIMIT 10""",
    ),
    "completion_search": (
        completion_search,
        f"""SELECT u.username, c.id, c.timestamp, ['queued', 'running', 'complete'][c.state + 1] AS state, c.input
            FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id WHERE CAST(c.timestamp AS DATE) = DATE '1998-10-03' AND c.input ILIKE '%low%' ORDER BY c.timestamp, c.id LIMIT 50""",
    ),
    "completion_export": (
        completion_export,
        f"""SELECT c.timestamp, u.username, 'MaskedLM' AS type, c.input, c.output, ['bad', 'fair', 'average', 'good', 'great'][c.rating + 1] AS rating, c.comments
            FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id WHERE c.timestamp >= TIMESTAMP '1997-01-01'""",
    ),
    "completion_serialize": (
        completion_serialize,
        f"""SELECT c.id, c.input, c.output, strftime(c.timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, c.state = 2 AS completed, u.username, c.rating, c.comments, c.state
            FROM ({fx.COMPLETIONS}) c JOIN ({fx.USERS}) u ON c.user_id = u.id""",
    ),
    "visible_completions": (visible_completions, f"SELECT id, state FROM ({fx.QUEUE}) WHERE user_id = 8"),
    "queue_next": (queue_next, f"SELECT id, timestamp FROM ({fx.QUEUE}) WHERE state = 0 ORDER BY timestamp, id LIMIT 1"),
    "queue_claim": (
        queue_claim,
        f"SELECT id, CASE WHEN state = 0 AND row_number() OVER (PARTITION BY state ORDER BY timestamp, id) <= 5 THEN 1 ELSE state END AS state FROM ({fx.QUEUE})",
    ),
    "queue_purge": (queue_purge, f"SELECT id, CASE WHEN state = 1 THEN 0 ELSE state END AS state FROM ({fx.QUEUE})"),
    "queue_running": (queue_running, f"SELECT count(*) AS running FROM ({fx.QUEUE}) WHERE state = 1"),
    "queue_pending": (queue_pending, f"SELECT bool_or(state <> 2) AS pending FROM ({fx.QUEUE})"),
    "queue_complete": (
        queue_complete,
        f"SELECT id, CASE WHEN state = 1 THEN 2 ELSE state END AS state, CASE WHEN state = 1 THEN 'out ' || id END AS output FROM ({fx.QUEUE})",
    ),
    "queue_insert": (
        queue_insert,
        rf"""SELECT id, state, input FROM ({fx.QUEUE}) UNION ALL
            SELECT item_id + 1000000000, 0, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) FROM benchmark""",
    ),
    "queue_delete": (queue_delete, "SELECT event_id AS id FROM events WHERE NOT (event_id = 0 AND user_id = 8)"),
    "feedback_upsert": (
        feedback_upsert,
        f"""SELECT q.id, CASE WHEN p.id IS NOT NULL THEN coalesce(p.rating, q.rating) ELSE q.rating END AS rating, CASE WHEN p.id IS NOT NULL THEN 'seen' ELSE q.comments END AS comments
            FROM ({fx.QUEUE}) q LEFT JOIN (SELECT doc_id AS id, quality * 5 - toxic AS rating FROM labels WHERE quality * 5 - toxic BETWEEN 0 AND 4) p ON q.id = p.id""",
    ),
    "users_admin": (users_admin, f"SELECT id, username FROM ({fx.USERS}) WHERE admin OR username = 'Customer#000000001'"),
    "users_get_or_create": (
        users_get_or_create,
        f"""SELECT id, username FROM ({fx.USERS}) UNION ALL
            SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY username), username
            FROM (SELECT DISTINCT s_name AS username FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer))""",
    ),
    "stream_worker": (
        stream_worker,
        rf"""SELECT id, 2 AS state, regexp_replace(lower(regexp_replace(regexp_replace(input, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g') AS output
            FROM ({fx.QUEUE}) WHERE state = 0""",
    ),
}
