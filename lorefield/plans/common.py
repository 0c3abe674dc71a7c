"""What the query modules share: table views and a small registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL twins, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as stored; rows may repeat, so results are reduced by key where they are small."""
    return read_table(spark, sf, "chunk_results")


def chunk_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag contributions: repeated rows count once."""
    return read_table(spark, sf, "tag_values").distinct()


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct files by id and path, without hash: a repeated row repeats every column."""
    return read_table(spark, sf, "files").dropDuplicates(["file_id"])


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors: the chunk's id, the vector and the topic tag."""
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("topic-"), F.col("label").cast("string")).alias("tag"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def vector_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, id): the vector that stands for a chunk, its id modulo their number, as the chunks have none of their own."""
    count = read_table(spark, sf, "embeddings").count()  # read from the footers
    return chunks(spark, sf).select("chunk_id").filter("chunk_id is not null").distinct().withColumn("id", F.col("chunk_id") % max(count, 1))
