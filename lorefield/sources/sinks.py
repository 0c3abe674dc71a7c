"""Output forms of results: JSON lines, wrapped XML, markdown and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def wrapped(tag: str, path: Column, text: Column) -> Column:
    """A text in an element that names its path; mark-up characters in the path are escaped."""
    safe = F.replace(F.replace(path, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit(f'<{tag} path="'), safe, F.lit('">\n'), text, F.lit(f"\n</{tag}>"))


def location(path: Column, chunk_range: Column) -> Column:
    """``path:range``, or the path alone without a range."""
    return F.when(F.coalesce(chunk_range, F.lit("")) == "", path).otherwise(F.concat_ws(":", path, chunk_range))


def markdown_item(path: Column, chunk_range: Column, score: Column) -> Column:
    """A list item with place and score."""
    return F.format_string("- `%s` (%.3f)", location(path, chunk_range), score)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
