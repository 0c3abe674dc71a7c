"""Cleaning rules shared by the operators on tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = " \t\u00a0"


def clean_value(value: Column) -> Column:
    """Strip spaces, tabs and no-break spaces at both ends; null becomes empty."""
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(EDGE))


def clean_tag(tag: Column) -> Column:
    """Strip, lower-case, then drop one leading ``@`` and one trailing ``:``; null becomes empty."""
    low = F.lower(clean_value(tag))
    at = F.when(low.startswith("@"), 2).otherwise(1)
    return F.substring(low, at, F.length(low) - at + F.when(low.endswith(":"), 0).otherwise(1))


def clean_sql(expr: str, tag: bool = False) -> str:
    """The same in DuckDB's SQL."""
    stripped = f"regexp_replace(coalesce({expr}, ''), '^[ \\t\\x{{00a0}}]+|[ \\t\\x{{00a0}}]+$', '', 'g')"
    return f"regexp_replace(lower({stripped}), '^@|:$', '', 'g')" if tag else stripped
