"""URL filters whose list changes over time (built-in functions only).

A list is a log of dated changes: an entry was added or removed at an instant. Consecutive changes
of an entry become validity intervals, and every capture is judged by the entries that were
active when it was fetched: an as-of join, on the keys under which a URL can be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Intervals that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 100_000


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port or final dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def url_keys(url: Column, most_labels: int, most_steps: int) -> Column:
    """All ``(kind, pattern)`` under which a URL can be listed.

    ``host``: its host; ``domain``: the host and each parent domain, of up to ``most_labels`` labels; ``prefix``: host and path
    up to each slash, of up to ``most_steps`` slashes. With the list's own depth for these nothing is missed, and a URL of very
    many slashes has no more keys than the list can match.
    """
    host = url_host(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    pair = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    least = F.greatest(F.lit(1), F.size(labels) - most_labels + 1)
    domains = F.transform(F.sequence(least, F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))) if most_labels else none
    # the path "/a/b/c" splits into "", "a", "b", "c": prefixes end before c
    prefixes = F.when(
        (F.size(steps) > 1) & (F.lit(most_steps) > 0),
        F.transform(F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(max(1, most_steps)))), lambda i: pair("prefix", F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))),
    ).otherwise(none)
    return F.when(host != "", F.concat(F.array(pair("host", host)), domains, prefixes)).otherwise(none)


def intervals(changes: DataFrame) -> DataFrame:
    """``kind, pattern, category, since, until`` from a log ``kind, pattern, category, at, action``.

    An entry is active from an ``add`` up to, not including, its next ``remove``; ``until`` is null while it
    is still active. At one instant the removal comes first, so an entry that is removed and added again goes on.
    Repeated changes say nothing new. Rows with a null pattern, kind or instant, or another action, are ignored.
    """
    entry = ["kind", "pattern", "category"]
    log = changes.filter(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull())
    log = log.select("kind", "pattern", F.coalesce("category", F.lit("")).alias("category"), "at", (F.col("action") == "add").alias("on"))
    # one state per instant: on if anything added then
    log = log.groupBy(*entry, "at").agg(F.bool_or("on").alias("on"))
    order = Window.partitionBy(*entry).orderBy("at")
    turns = log.withColumn("was", F.lag("on").over(order)).filter(F.coalesce(F.col("was"), F.lit(False)) != F.col("on"))
    return turns.withColumn("until", F.lead("at").over(order)).filter("on").select(*entry, F.col("at").alias("since"), "until")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (``url, fetched_at`` and others) with the verdict of the list at fetch time.

    Adds ``blocked``, ``n_active`` (entries that match then), ``entry`` (``kind:pattern`` of the longest
    pattern, ties by name) and ``category`` (of that entry; the first by name of several).

    A capture without fetch time, URL or host matches nothing. Repeated rows are judged alike and
    all returned. An empty list blocks nothing; empty captures give an empty result. Extra columns stay,
    but for ``blocked, n_active, entry, category``, which are replaced.

    Only distinct captures are exploded into keys, no more for each than the list's deepest entries have steps, however long
    the URL. A list within
    ``BROADCAST_ROWS`` intervals is broadcast; a longer one is joined on its key, where Spark splits the
    captures of a host that holds much of the table.
    """
    names = ("blocked", "n_active", "entry", "category")
    base = captures.drop(*names)
    periods = stage(intervals(changes), "url-intervals")
    depth = lambda kind, mark: F.max(F.when(F.col("kind") == kind, F.size(F.split("pattern", mark))))
    n, labels, steps = periods.agg(F.count("*"), F.coalesce(depth("domain", r"\."), F.lit(0)), F.coalesce(depth("prefix", "/") - 1, F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        periods = F.broadcast(periods)
    wanted = base.select("url", "fetched_at").filter("url is not null and fetched_at is not null").distinct()
    keys = wanted.select("url", "fetched_at", F.explode(url_keys(F.col("url"), labels, steps)).alias("k")).select("url", "fetched_at", "k.kind", "k.pattern")
    met = keys.join(periods, ["kind", "pattern"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    best = F.min(F.struct((-F.length("pattern")).alias("n"), "kind", "pattern", "category"))
    verdicts = met.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), best.alias("best"))
    verdicts = verdicts.select(
        F.col("url").alias("hit_url"),
        F.col("fetched_at").alias("hit_at"),
        "n_active",
        F.concat_ws(":", "best.kind", "best.pattern").alias("entry"),
        F.col("best.category").alias("category"),
    )
    return base.join(verdicts, (base["url"] == verdicts["hit_url"]) & (base["fetched_at"] == verdicts["hit_at"]), "left").select(
        *[base[c] for c in base.columns],
        F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "entry",
        "category",
    )
