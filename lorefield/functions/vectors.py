"""Vector expressions; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of different length and for a vector of norm zero; null for null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def normalised(cos: Column) -> Column:
    """A cosine mapped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def centroid_sum(rows, key: str, vec: str):
    """(key, sum, count) per group: the sums are kept by dimension, so groups of any size combine partially."""
    flat = rows.select(key, F.posexplode(as_double(F.col(vec))).alias("dim", "x"))
    sums = flat.groupBy(key, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    packed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("parts"), F.max("n").alias("count"))
    return packed.select(key, F.transform("parts", lambda p: p["s"]).alias("sum"), "count")
