"""Locators: short anchors that name one chunk of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefield.functions import text as T


def suggest(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, path, anchor): the shortest beginning of a line that no other chunk of the file contains.

    ``wanted`` names the chunks. Every beginning of every line is tried, up to the whole line; of equally
    long ones the one on the earlier line counts. Without any, the anchor is the chunk's range.
    """
    rows = chunks.filter("chunk_id is not null and path is not null").select("chunk_id", "path", "chunk_range", F.coalesce("text", F.lit("")).alias("text")).distinct()
    mine = rows.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")
    lines = mine.select("chunk_id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.split(T.trim_all(F.col("line")), r"\s+")
    sizes = F.sequence(F.lit(1), F.size(words))
    tries = lines.filter("trim(line) <> ''").select("chunk_id", "path", "line_no", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("anchor")))).alias("t"))
    tries = tries.select("chunk_id", "path", "line_no", "t.n", "t.anchor").distinct()
    others = rows.select(F.col("chunk_id").alias("other"), "path", F.col("text").alias("body"))
    clash = tries.join(others, "path").filter((F.col("other") != F.col("chunk_id")) & F.contains("body", F.col("anchor"))).select("chunk_id", "path", "line_no", "n", "anchor").distinct()
    free = tries.join(clash, ["chunk_id", "path", "line_no", "n", "anchor"], "left_anti")
    w = Window.partitionBy("chunk_id").orderBy("n", "line_no", "anchor")
    best = free.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("chunk_id", "anchor")
    where = mine.groupBy("chunk_id").agg(F.min("path").alias("path"), F.min("chunk_range").alias("chunk_range"))
    return where.join(best, "chunk_id", "left").select("chunk_id", "path", F.coalesce("anchor", "chunk_range").alias("anchor"))
