"""Size statistics with exact floor-index percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def size_statistics(rows: DataFrame, group: str, size: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, n, least, most, mean, pXX...) per group and for ``all``.

    The percentile of share p is the value at index ``floor(p * (n - 1))`` of the sorted sizes. Sizes
    are first counted per distinct value, which combines partially; the window runs over those counts.
    """
    hist = rows.groupBy(group, size).agg(F.count("*").alias("c"))
    total = hist.groupBy(size).agg(F.sum("c").alias("c")).withColumn(group, F.lit("all"))
    both = hist.select(group, size, "c").unionByName(total.select(group, size, "c"))
    up = Window.partitionBy(group).orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    cum = both.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(size))).alias(f"p{round(p * 100)}") for p in shares]
    out = cum.groupBy(group).agg(F.max("n").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.floor(F.sum(F.col(size) * F.col("c")) / F.max("n")).alias("mean"), *picks)
    return out


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
