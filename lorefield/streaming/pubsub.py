"""Publish and subscribe as Structured Streaming.

Sources are Parquet folders read file by file (a deployment would read a log instead); every job here
can also run to completion with ``available_now``. State lives in Spark's state store or, for
``foreachBatch`` jobs, in Parquet tables below the shared folder, so a restarted executor or driver
resumes from the checkpoint.

Spark has no queue that drops its overflow: back-pressure is ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.functions import text as T
from lorefield.operators import events as V
from lorefield.session import scratch_path


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files at ``path``, a file or a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if "*" in path else f"{path}*")


def run_to_end(stream: DataFrame, label: str, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and return what it wrote.

    ``each`` transforms every micro-batch. The batch id is part of the output path, so a batch that is
    run again overwrites its own rows only.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    schema: list = []

    def write(batch: DataFrame, number: int) -> None:
        out = batch if each is None else each(batch, number)
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema[0]).parquet(f"{base}/out/batch=*")


def published(stream: DataFrame, subs: list[V.Subscription]) -> DataFrame:
    """Matches of a stream with the subscriptions, each event once.

    Events are deduplicated by id within the watermark, so the state is bounded by time.
    """
    rows = stream.filter("event_id is not null and tag is not null and ts is not null")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days").dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.withColumn("tag", F.lower(T.strip("tag"))).withColumn("value", F.coalesce("value", F.lit("")))
    return V.match(rows, subs)


def new_pairs(stream: DataFrame) -> DataFrame:
    """(path, tag, value): pairs that a path has not published before.

    The state is keyed by the whole triple, so a path with very many events is spread over tasks.
    """
    rows = stream.filter("path is not null and tag is not null")
    rows = rows.select("path", F.lower(T.strip("tag")).alias("tag"), F.coalesce("value", F.lit("")).alias("value"))
    return rows.dropDuplicates(["path", "tag", "value"])


class MembershipState:
    """Transitions of a stream across micro-batches.

    Within a batch they come from a window per path; the last membership of every path is a table that
    each batch reads and replaces in a new version, named by the batch. The state is in these tables alone: with a
    ``path`` a restarted job goes on from the version of the batch before.
    """

    def __init__(self, spark: SparkSession, member: Column, path: str | None = None):
        self.spark, self.member = spark, member
        self.base = path or scratch_path(spark, "membership")

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        rows = V.clean_events(batch).filter("path is not null and ts is not null").persist()
        before = None if number == 0 else self.spark.read.parquet(f"{self.base}/v{number - 1}")
        found = V.transitions(rows, self.member)
        if before is not None:
            # the first event of a path in this batch follows the path's last one in the batches before
            first = rows.groupBy("path").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
            inside = before.filter("is_in").select("path").join(rows.select("path").distinct(), "path", "left_semi")
            lead = first.join(inside, "path").join(rows.select("event_id", self.member.alias("is_now")), "event_id")
            patch = lead.select("event_id", F.when(F.col("is_now"), "stay").otherwise("leave").alias("patched"), "path")
            merged = found.join(patch.withColumnRenamed("path", "p2"), "event_id", "full_outer")
            found = merged.select(F.coalesce("path", "p2").alias("path"), "event_id", F.coalesce("patched", "change").alias("change"))
        now = rows.groupBy("path").agg(F.max_by(self.member, F.struct("ts", "event_id")).alias("is_in"))
        state = now if before is None else now.unionByName(before.join(now.select("path"), "path", "left_anti"))
        path = f"{self.base}/v{number}"
        state.write.mode("overwrite").parquet(path)
        return found


def windowed_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    """(start, tag, n): events per tumbling window and tag, with late events dropped behind the watermark.

    An extension: event-time windows are no operator of the survey.
    """
    rows = stream.filter("tag is not null and ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.lower(T.strip("tag")).alias("tag"))
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "tag").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "tag", "n")
