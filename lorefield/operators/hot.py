"""Hot correlations: the best chunks of every tag as a stored table that sweeps keep up to date.

A sweep takes the chunk vectors and the tags' definitions with the serial of their last write, and the bookmark of the
sweep before. Tags with a definition behind the bookmark are built anew; in the buckets of all other tags only the
chunks behind it are scored, and displace what is stored. A stored chunk that has changed leaves its bucket first. A bucket
that falls below its old last score is built anew as well, since a chunk that was never stored could belong into it;
so the table is always that of a sweep from scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorefield.operators import vector_search as X
from lorefield.session import scratch_path

SCHEMA = "tag string, chunk_id long, score double, serial long"


class HotTable:
    """Buckets ``(tag, chunk_id, score, serial)`` of ``k`` chunks a tag; ``sweep`` writes a new version and returns it."""

    def __init__(self, spark: SparkSession, path: str | None = None, k: int = 20, digits: int = 9, version: int = -1, bookmark: int = 0):
        self.spark, self.k, self.digits, self.version, self.bookmark = spark, k, digits, version, bookmark
        self.root = path or scratch_path(spark, "hot")

    def buckets(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/v{self.version}")

    def _scored(self, chunks: DataFrame, defs: DataFrame) -> DataFrame:
        q = defs.select(F.col("tag").alias("grp"), F.xxhash64("tag", "file_id").alias("qid"), "vec")
        return X.top_k(chunks, q, self.k, digits=self.digits).select(F.col("grp").alias("tag"), F.col("id").alias("chunk_id"), "score")

    def sweep(self, chunks: DataFrame, defs: DataFrame) -> HotTable:
        """Bring the buckets up to ``chunks(id, vec, serial)`` and ``defs(tag, file_id, vec, serial)``."""
        serial = max((x[0] or 0) for side in (chunks, defs) for x in side.agg(F.max("serial")).collect())
        out = HotTable(self.spark, self.root, self.k, self.digits, self.version + 1, max(serial, self.bookmark))
        if self.version < 0:
            rows = self._scored(chunks, defs)
        else:
            tags, changed = defs.select("tag").distinct(), chunks.filter(F.col("serial") > self.bookmark)
            edited = defs.filter(F.col("serial") > self.bookmark).select("tag").distinct()
            stored = self.buckets().join(tags, "tag", "left_semi").join(edited, "tag", "left_anti").select("tag", "chunk_id", "score")
            kept = stored.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").join(changed.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
            fresh = self._scored(changed, defs.join(edited, "tag", "left_anti"))
            rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "chunk_id"))
            merged = kept.unionByName(fresh).withColumn("rank", rank).filter(F.col("rank") <= self.k).drop("rank")
            before = stored.groupBy("tag").agg(F.count("*").alias("was"), F.min("score").alias("floor"))
            now = merged.groupBy("tag").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            # a bucket that was full says nothing about chunks below its old last score
            short = before.join(now, "tag", "left").filter((F.col("was") >= self.k) & ((F.coalesce("n", F.lit(0)) < self.k) | (F.col("last") < F.col("floor"))))
            anew = edited.unionByName(short.select("tag")).unionByName(tags.join(before.select("tag"), "tag", "left_anti")).distinct()
            rows = merged.join(anew, "tag", "left_anti").unionByName(self._scored(chunks, defs.join(anew, "tag", "left_semi")))
        rows.select("tag", "chunk_id", "score", F.lit(out.bookmark).cast("long").alias("serial")).write.mode("overwrite").parquet(f"{self.root}/v{out.version}")
        return out

    def fresh(self, chunks: DataFrame, defs: DataFrame) -> DataFrame:
        """Entries no older than their chunk ``(id, serial)`` and the newest definition ``(tag, serial)`` of their tag."""
        of_chunk = chunks.groupBy(F.col("id").alias("chunk_id")).agg(F.max("serial").alias("c"))
        of_tag = defs.groupBy("tag").agg(F.max("serial").alias("d"))
        return self.buckets().join(of_chunk, "chunk_id").join(of_tag, "tag").filter((F.col("serial") >= F.col("c")) & (F.col("serial") >= F.col("d"))).select("tag", "chunk_id", "score")
