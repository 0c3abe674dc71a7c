"""Stored tables: whole-partition replacement and keyed reads.

A table is a Parquet folder partitioned by one column. Replacing a partition writes only that
partition's files, so the tags or vectors of one file are swapped without touching the rest. A reader that
runs at the same time sees the old or the new files of a partition, as Spark's commit moves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows``, replacing exactly the partitions that they name."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def get_many(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of the given keys; a semi-join, so any number of keys will do."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def missing(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The wanted keys that the table doesn't have."""
    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti")


def stamp(rows: DataFrame, path: str, serial: int) -> None:
    """Append rows under the serial of their write; serials only grow."""
    rows.withColumn("serial", F.lit(serial).cast("long")).write.mode("append").partitionBy("serial").parquet(path)


def since(spark: SparkSession, path: str, schema: str, bookmark: int) -> DataFrame:
    """Rows written after a bookmark, with their serial: whole partitions, so nothing older is read."""
    return read(spark, path, f"{schema}, serial long").filter(F.col("serial") > bookmark)


def latest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The newest row of every key."""
    rows = read(spark, path, f"{schema}, serial long")
    newest = rows.groupBy(key).agg(F.max("serial").alias("serial"))
    return rows.join(newest, [key, "serial"], "left_semi")
