"""Frequency of every distinct term: occurrences, records, and marks for too rare and too common.

Per-record term counts come first (``groupBy(field, term, record)``): Spark combines them partially
by hash before the shuffle, and because the record is part of the key no hot term meets in one task.
The second aggregation, on ``(field, term)``, again combines partially, so a term that holds a third
of all rows arrives as one partial row per task.

Edge cases: null and empty terms are left out; a repeated row counts once; rows without a record id
take no part; a field without records has no rows; other columns are ignored. Ties don't arise: every
term is reported. A term that is both too rare and too common (possible only among very few records)
is marked ``rare``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TermField:
    """A field whose terms are counted.

    ``rows`` holds one row per contribution, ``keys`` the columns that make a row (a repetition of
    all of them counts once), ``weight`` the number of occurrences a row stands for.
    """

    name: str
    rows: DataFrame
    record: str
    term: Column
    keys: tuple[str, ...]
    common_share: tuple[int, int]
    weight: Column | None = None


def term_counts(fields: list[TermField], min_records: int = 3) -> DataFrame:
    """(field, term, occurrences, records, mark) for every term of every field.

    ``mark`` is ``rare`` below ``min_records`` records, ``common`` above the field's share of all
    records, else null.
    """
    parts = totals = None
    for f in fields:
        weight = F.lit(1) if f.weight is None else F.coalesce(f.weight, F.lit(1))
        rows = f.rows.filter(F.col(f.record).isNotNull())
        one = (
            rows.select(*f.keys, F.col(f.record).cast("long").alias("__record"), f.term.alias("__term"), weight.cast("long").alias("__n"))
            .distinct()
            .select(F.lit(f.name).alias("field"), F.col("__term").alias("term"), F.col("__record").alias("record"), F.col("__n").alias("n"))
            .filter("term <> ''")
        )
        num, den = f.common_share
        total = rows.select(F.col(f.record).alias("r")).distinct().agg(F.count("*").alias("total"))
        total = total.select(F.lit(f.name).alias("field"), "total", F.lit(num).alias("num"), F.lit(den).alias("den"))
        parts = one if parts is None else parts.unionByName(one)
        totals = total if totals is None else totals.unionByName(total)
    per_record = parts.groupBy("field", "term", "record").agg(F.sum("n").alias("n"))
    counts = per_record.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") * F.col("den") > F.col("total") * F.col("num"), "common")
    # ``totals`` has one row per field
    return counts.join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", mark.alias("mark"))
