"""File listings: scan, strategy choice, status, change detection, sweep and bookkeeping."""

from __future__ import annotations

import glob as _glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorefield.functions import globs


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, length, mtime, class) of the files below a folder; the content is not read.

    Listing is Spark's own, so it is distributed over folders; classes are ``included``, ``excluded`` and
    ``unresolved``. Spark's file sources leave empty files out, so these never reach the rules.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    prefix = os.path.abspath(root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quote(prefix), "")
    cls = globs.classify(rel, include, exclude)
    return rows.select(rel.alias("path"), "length", F.col("modificationTime").alias("mtime"), cls.alias("class"))


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def expand_sources(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(folders, orphans): source globs expanded on the driver, and the patterns without a folder."""
    found, orphans = [], []
    for p in patterns:
        hit = sorted(d for d in _glob.glob(os.path.expanduser(p), recursive=True) if os.path.isdir(d))
        found += hit
        if not hit:
            orphans.append(p)
    return list(dict.fromkeys(found)), orphans


def strategy_for(path: Column, strategies: dict[str, str], default: str = "lines") -> Column:
    """The strategy of the longest matching glob; of equally long ones the first in order of code points.

    The patterns are a small configuration, so the choice is one expression and needs no join.
    """
    out = None
    for pattern in sorted(strategies, key=lambda p: (-len(p), p)):
        hit = globs.matches(path, pattern)
        out = F.when(hit, strategies[pattern]) if out is None else out.when(hit, strategies[pattern])
    return F.lit(default) if out is None else out.otherwise(default)


def explain_rules(paths: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(path, rules, conflict): which patterns include or exclude a path, as ``kind:pattern@origin``.

    ``rules`` lists (kind, pattern, origin). A path with both kinds is in conflict.
    """
    cells = [F.when(globs.matches(F.col("path"), p), F.lit(f"{kind}:{p}@{origin}")) for kind, p, origin in rules]
    hit = F.filter(F.array(*cells), lambda c: c.isNotNull())
    both = F.exists(hit, lambda c: c.startswith("include")) & F.exists(hit, lambda c: c.startswith("exclude"))
    return paths.select("path", F.array_join(hit, "|").alias("rules"), both.alias("conflict"))


def source_for(paths: DataFrame, sources: list[str]) -> DataFrame:
    """(path, source): the first configured folder that contains the path; null if none does."""
    out = None
    for s in sources:
        hit = F.col("path").startswith(s.rstrip("/") + "/")
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return paths.select("path", (F.lit(None).cast("string") if out is None else out).alias("source"))


def status(index: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, code): G good, S stale, M missing on disk, N new, by length and hash."""
    i = index.select("path", F.col("length").alias("il"), F.col("hash").alias("ih"), F.lit(True).alias("known"))
    d = listing.select("path", F.col("length").alias("dl"), F.col("hash").alias("dh"), F.lit(True).alias("there"))
    code = F.when(F.col("there").isNull(), "M").when(F.col("known").isNull(), "N").when(F.col("il").eqNullSafe(F.col("dl")) & F.col("ih").eqNullSafe(F.col("dh")), "G").otherwise("S")
    return i.join(d, "path", "full_outer").select("path", code.alias("code"))


def change_kind(text: Column, old_length: Column, old_hash: Column) -> Column:
    """``unchanged``, ``append`` (the old text is a prefix, by hash) or ``changed``."""
    same = (F.length(text) == old_length) & (F.sha2(text, 256) == old_hash)
    grown = (F.length(text) > old_length) & (F.sha2(F.substring(text, F.lit(1), old_length.cast("int")), 256) == old_hash)
    return F.when(same, "unchanged").when(grown, "append").otherwise("changed")


def appended(text: Column, old_length: Column) -> Column:
    """What an appended text has behind its old length."""
    return F.substring(text, (old_length + 1).cast("int"), F.length(text))


def sweep(index: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Indexed paths that no source rule includes any more."""
    return index.filter(globs.classify(F.col("path"), include, exclude) != "included")


def skip_known_empty(listing: DataFrame, memo: DataFrame) -> DataFrame:
    """Listed files without those remembered as empty at the same mtime."""
    return listing.join(memo.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")


def dismiss(rows: DataFrame, pattern: str) -> DataFrame:
    """Bookkeeping rows that the glob doesn't dismiss."""
    return rows.filter(~globs.matches(F.col("path"), pattern))


def diff_config(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, reaction): added, removed or changed settings, and what each asks for."""
    o, n = old.select("key", F.col("value").alias("was")), new.select("key", F.col("value").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    deferred = F.col("key").rlike("^(case|chunker)")
    reaction = F.when(deferred, "defer").when(F.col("key").rlike("^tag_model"), "minimal").otherwise("benign")
    return o.join(n, "key", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select("key", change.alias("change"), reaction.alias("reaction"))


def latest_per_path(rows: DataFrame, order: str) -> DataFrame:
    """The last row of every path."""
    w = Window.partitionBy("path").orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
