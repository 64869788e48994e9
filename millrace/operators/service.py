"""Relational operations of an inference service: a queue of completions and the users who asked for them.

State changes are functions from one version of the table to the next; a writer stores the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownUser
from ..functions import text
from ..schema import require
from .frame import number

#: States, types and ratings of completions.
STATES = {0: "queued", 1: "running", 2: "complete"}
QUEUED, RUNNING, COMPLETE = STATES
TYPES = {0: "MaskedLM"}
RATINGS = {0: "bad", 1: "fair", 2: "average", 3: "good", 4: "great"}


def next_queued(queue: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest queued rows, ties by id; a top-n, not a sort of the table."""
    require(queue, ("id", "state", "timestamp"))
    return queue.filter(F.col("state") == QUEUED).orderBy("timestamp", "id").limit(n)


def claim(queue: DataFrame, n: int = 1) -> DataFrame:
    """The table with the ``n`` oldest queued rows running; a row that is not queued is never claimed."""
    taken = next_queued(queue, n).select("id", F.lit(True).alias("_taken"))
    state = F.when(F.col("_taken") & (F.col("state") == QUEUED), RUNNING).otherwise(F.col("state"))
    return queue.join(F.broadcast(taken), "id", "left").withColumn("state", state.cast("int")).drop("_taken")


def complete(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The table with results (``id, output``) written and their rows complete."""
    done = results.select("id", F.col("output").alias("_output"), F.lit(True).alias("_done"))
    out = queue.join(done, "id", "left").withColumn("state", F.when(F.col("_done"), COMPLETE).otherwise(F.col("state")).cast("int"))
    return out.withColumn("output", F.when(F.col("_done"), F.col("_output")).otherwise(F.col("output"))).drop("_output", "_done")


def purge(queue: DataFrame) -> DataFrame:
    """Running rows queued again."""
    return queue.withColumn("state", F.when(F.col("state") == RUNNING, QUEUED).otherwise(F.col("state")).cast("int"))


def running(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("state") == RUNNING).alias("running"))


def pending(queue: DataFrame) -> DataFrame:
    """Whether any row is not complete."""
    return queue.agg(F.coalesce(F.bool_or(F.col("state") != COMPLETE), F.lit(False)).alias("pending"))


def insert(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The table with new requests (``id, user_id, type, input, timestamp``), their input sanitised, queued."""
    new = requests.withColumn("input", text.sanitize(F.col("input"))).withColumn("state", F.lit(QUEUED))
    return queue.unionByName(new, allowMissingColumns=True)


def visible(queue: DataFrame, user_id: int, admin: bool = False) -> DataFrame:
    """What a user may see: all for an administrator, else their own."""
    return queue if admin else queue.filter(F.col("user_id") == user_id)


def delete(queue: DataFrame, id_: int, user_id: int, admin: bool = False) -> DataFrame:
    """The table without a row, if the user may delete it."""
    gone = (F.col("id") == id_) & (F.lit(admin) | (F.col("user_id") == user_id))
    return queue.filter(~F.coalesce(gone, F.lit(False)))


def valid_rating(rating: Column) -> Column:
    return rating.isNull() | rating.isin(*RATINGS)


def upsert_feedback(queue: DataFrame, feedback: DataFrame) -> DataFrame:
    """The table with new ratings and comments (``id, rating, comments``); invalid ratings are left out."""
    new = feedback.filter(valid_rating(F.col("rating"))).select("id", F.col("rating").alias("_rating"), F.col("comments").alias("_comments"), F.lit(True).alias("_new"))
    out = queue.join(new, "id", "left")
    for name in ("rating", "comments"):
        out = out.withColumn(name, F.when(F.col("_new"), F.coalesce(f"_{name}", name)).otherwise(F.col(name)))
    return out.drop("_rating", "_comments", "_new")


def serialize(queue: DataFrame) -> DataFrame:
    """The fields that a client receives."""
    return queue.select(
        "id", "input", "output", text.iso_utc(F.col("timestamp")).alias("timestamp"), (F.col("state") == COMPLETE).alias("completed"),
        "username", "rating", "comments", "state",
    )


def set_admin(users: DataFrame, username: str, admin: bool = True) -> DataFrame:
    """The users with one's flag set; an unknown name raises."""
    if not users.filter(F.col("username") == username).limit(1).count():
        raise UnknownUser(username)
    return users.withColumn("admin", F.when(F.col("username") == username, F.lit(admin)).otherwise(F.col("admin")))


def get_or_create(users: DataFrame, names: DataFrame) -> DataFrame:
    """The users with those of ``names`` (``username``) that are new; ids go on from the largest."""
    new = names.select("username").distinct().join(users.select("username"), "username", "left_anti")
    last = users.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = number(new, "_place", "username").select((F.col("_place") + last + 1).alias("id"), "username", F.lit(False).alias("admin"))
    return users.select("id", "username", "admin").union(rows)


def with_users(completions: DataFrame, users: DataFrame) -> DataFrame:
    """Completions with ``username, admin`` of the user who asked."""
    return completions.join(users.select(F.col("id").alias("user_id"), "username", "admin"), "user_id")


def list_completions(completions: DataFrame, users: DataFrame, limit: int = 10, user: str | None = None, date: str | None = None, pattern: str | None = None) -> DataFrame:
    """The oldest completions, by user, day or part of the input."""
    out = with_users(completions, users)
    if user is not None:
        out = out.filter(F.col("username") == user)
    if date is not None:
        out = out.filter(F.to_date("timestamp") == F.lit(date).cast("date"))
    if pattern:
        out = out.filter(F.contains(F.lower("input"), F.lit(pattern.lower())))
    state = text.decode_enum(F.col("state"), STATES)
    return out.orderBy("timestamp", "id").limit(limit).select("username", "id", "timestamp", state.alias("state"), "input")


def newest(completions: DataFrame, users: DataFrame, user_id: int, admin: bool = False, limit: int = 100) -> DataFrame:
    """What a user's page lists: the completions that they may see, the newest first, as a client receives them."""
    rows = with_users(visible(completions, user_id, admin), users)
    return serialize(rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit))


def export(completions: DataFrame, users: DataFrame, start: str | None = None) -> DataFrame:
    """All completions since ``start`` for analysis."""
    out = with_users(completions, users)
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    return out.select(
        "timestamp", "username", text.decode_enum(F.col("type"), TYPES).alias("type"), "input", "output",
        text.decode_enum(F.col("rating"), RATINGS).alias("rating"), "comments",
    )


def user_report(users: DataFrame, completions: DataFrame) -> DataFrame:
    """``username, admin, completions, feedback`` of every user, those without completions too.

    Completions are counted by user before the join, so that a user with much of the table is one row in it.
    """
    has = F.col("rating").isNotNull() | F.col("comments").isNotNull()
    per = completions.groupBy("user_id").agg(F.count("id").alias("_n"), F.sum(F.when(has, 1).otherwise(0)).alias("_f"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return users.join(per, users["id"] == per["user_id"], "left").select("username", "admin", zero("_n").alias("completions"), zero("_f").alias("feedback"))
