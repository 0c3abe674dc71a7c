"""Events and subscriptions: matching, compression, watchdog and statistics, in batch form.

The streaming forms in ``lorefield.streaming`` apply the same functions to each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import globs
from lorefield.functions import text as T
from lorefield.functions.predicates import parse_predicate


def clean_events(events: DataFrame) -> DataFrame:
    """Distinct events with an id and a tag; the tag is lower-cased, a null value is empty."""
    rows = events.filter("event_id is not null and tag is not null").dropDuplicates(["event_id"])
    return rows.withColumn("tag", F.lower(T.strip("tag"))).withColumn("value", F.coalesce("value", F.lit("")))


class Subscription:
    """A session's interest: a tag predicate, and globs that a path must or mustn't match."""

    def __init__(self, session: str, predicate: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()):
        self.session, self.text, self.include, self.exclude = session, predicate, include, exclude
        self.predicate = parse_predicate(predicate)

    def on(self) -> Column:
        """The subscription as an expression over an event's columns."""
        hit = self.predicate.on(F.col("tag"), F.col("value")) & globs.passes(F.col("path"), list(self.include), list(self.exclude))
        return hit & ~F.coalesce(F.col("session") == self.session, F.lit(False))


def match(events: DataFrame, subs: list[Subscription], muted: DataFrame | None = None) -> DataFrame:
    """(subscriber, subscription, event columns): one row per event and matching subscription.

    Subscriptions are configuration, so they become one expression that is evaluated in a single pass;
    an event isn't shown to the session that wrote it. Paths in ``muted`` are silent.
    """
    cells = [F.when(s.on(), F.struct(F.lit(s.session).alias("subscriber"), F.lit(s.text).alias("subscription"))) for s in subs]
    rows = events if muted is None else events.join(muted.select("path").distinct(), "path", "left_anti")
    hits = rows.withColumn("__hit", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    return hits.select("__hit.subscriber", "__hit.subscription", "event_id", "tag", "value", "path", "ts")


def notify(matches: DataFrame) -> DataFrame:
    """One notification per subscriber, tag and value, for the first matching event."""
    return matches.groupBy("subscriber", "tag", "value").agg(F.min("event_id").alias("event_id"))


def compress(events: DataFrame, order: str = "event_id") -> DataFrame:
    """The latest event per path and tag, with the place of the first one as its rank."""
    best = events.groupBy("path", "tag").agg(F.max_by(F.struct("value", "ts", "event_id"), order).alias("last"), F.min(order).alias("first_seen"))
    return best.select("path", "tag", "last.value", "last.ts", "last.event_id", "first_seen")


def subscriber_stats(matches: DataFrame, depth: int) -> DataFrame:
    """(subscriber, subscription, hits, drops): what a queue of the given depth would have dropped."""
    n = matches.groupBy("subscriber", "subscription").agg(F.count("*").alias("hits"))
    return n.select("subscriber", "subscription", "hits", F.greatest(F.col("hits") - depth, F.lit(0)).alias("drops"))


def transitions(events: DataFrame, member: Column) -> DataFrame:
    """(path, event_id, change): enter, stay or leave, where ``member`` says whether an event keeps the path in.

    A path's events are ordered by time and id; those of paths outside that stay outside are dropped.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ts", "event_id")
    rows = events.withColumn("__is", member).withColumn("__was", F.coalesce(F.lag("__is").over(w), F.lit(False)))
    change = F.when(~F.col("__was") & F.col("__is"), "enter").when(F.col("__was") & F.col("__is"), "stay").when(F.col("__was") & ~F.col("__is"), "leave")
    return rows.select("path", "event_id", change.alias("change")).filter("change is not null")


def watchdog(events: DataFrame, subscribed: list[str], least: float = 0.4) -> DataFrame:
    """(kind, tag, value, near_tag, score): unsubscribed tags that look schedulable, or nearly subscribed.

    Distinct pairs are tested against the subscribed names, which are literals.
    """
    rows = events.select("tag", "value").distinct().filter(~F.col("tag").isin(*subscribed))
    orphans = rows.filter(D.looks_schedulable(F.col("value"))).select(F.lit("orphan-schedule").alias("kind"), "tag", "value", F.lit(None).cast("string").alias("near_tag"), F.lit(None).cast("double").alias("score"))
    cells = F.array(*[F.struct(F.lit(s).alias("near_tag"), F.round(T.jaccard(T.literal_codes(s), T.gram_codes(F.col("tag"))), 6).alias("score")) for s in subscribed])
    typos = rows.select("tag", "value", F.explode(F.filter(cells, lambda c: c["score"] >= least)).alias("c"))
    return orphans.unionByName(typos.select(F.lit("possible-typo").alias("kind"), "tag", "value", "c.near_tag", "c.score"))


def reap(events: DataFrame, idle_seconds: int) -> DataFrame:
    """(session, last): sessions whose last event is within ``idle_seconds`` of the latest of all."""
    last = events.filter("session is not null and ts is not null").groupBy("session").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("newest")).withColumn("k", F.lit(1))
    rows = last.withColumn("k", F.lit(1)).join(F.broadcast(newest), "k")  # one row
    return rows.filter(F.unix_timestamp(F.col("newest").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) <= idle_seconds).select("session", "last")
