"""Schedules: expanding dated and recurring tags into events, with acknowledgements and exceptions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import text as T


def one_shot(tags: DataFrame, tag: str, start: str, end: str) -> DataFrame:
    """(chunk_id, day, value): events of ISO-dated values of one tag within [start, end]."""
    rows = tags.filter((F.lower("tag") == tag) & F.col("value").isNotNull() & F.col("chunk_id").isNotNull())
    rows = rows.select("chunk_id", D.iso_date(F.col("value")).alias("day"), T.strip("value").alias("value")).distinct()
    return rows.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def recurring(tags: DataFrame, tag: str, start: datetime, end: datetime) -> DataFrame:
    """(chunk_id, at, spec): every occurrence of the recurring values of one tag within [start, end].

    Distinct specifications are expanded once, then joined to their chunks, so the Python work grows with
    the number of specifications and not with their use.
    """
    rows = tags.filter((F.lower("tag") == tag) & F.col("chunk_id").isNotNull()).select("chunk_id", T.strip(F.regexp_replace("value", " ", " ")).alias("spec"))
    rows = rows.filter(F.lower("spec").contains("every ")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for spec in pdf["spec"]:
                low, high, rest = D.bounds(spec)
                a = max(start, datetime.combine(low, datetime.min.time())) if low else start
                b = min(end, datetime.combine(high, datetime.max.time())) if high else end
                out += [(spec, at) for at in D.expand(rest, a, b)]
            frame = pd.DataFrame(out, columns=["spec", "at"])
            frame["at"] = frame["at"].astype("datetime64[us]")
            yield frame

    events = rows.select("spec").distinct().mapInPandas(run, "spec string, at timestamp_ntz")
    return rows.join(events, "spec").select("chunk_id", "at", "spec")


def acknowledged(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events (chunk_id, day, ...) that no acknowledgement (chunk_id, interval) of their chunk covers."""
    hit = events.alias("e").join(acks.alias("a"), (F.col("e.chunk_id") == F.col("a.chunk_id")) & D.covers(F.col("a.interval"), F.col("e.day")), "left_anti")
    return hit


def acks_of(tags: DataFrame) -> DataFrame:
    """(chunk_id, interval) of the acknowledgements with a readable end."""
    rows = tags.filter((F.lower("tag") == "ack") & F.col("value").isNotNull() & F.col("chunk_id").isNotNull())
    rows = rows.select("chunk_id", D.ack_interval(F.col("value")).alias("interval")).distinct()
    return rows.filter("interval.end is not null")


def with_exceptions(events: DataFrame, removes: DataFrame, adds: DataFrame) -> DataFrame:
    """Events (chunk_id, day) minus removed days plus added ones."""
    kept = events.select("chunk_id", "day").join(removes.select("chunk_id", "day").distinct(), ["chunk_id", "day"], "left_anti")
    return kept.unionByName(adds.select("chunk_id", "day")).distinct()


def trim_log(log: DataFrame, cap: int) -> DataFrame:
    """The log, cut to the latest half of the cap where a source's tag exceeds it."""
    w = Window.partitionBy("tag", "path").orderBy(F.desc("ts"), F.desc("event_id"))
    n = Window.partitionBy("tag", "path")
    rows = log.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(n))
    return rows.filter((F.col("n") <= cap) | (F.col("rn") <= cap // 2)).drop("rn", "n")
