"""Tag vocabulary operators over contributions ``(chunk_id, tag, value, n, origin)``.

A contribution is one row: the table is a multiset whose repetitions of a whole row count once. Null
tags and chunks take part in nothing; a null value counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefield.functions import text as T


def sources(tags: DataFrame) -> DataFrame:
    """Contributions with a known source, ready to be counted."""
    return tags.filter("tag is not null and chunk_id is not null").withColumn("value", F.coalesce("value", F.lit("")))


def totals(tags: DataFrame) -> DataFrame:
    """(tag, n): distinct chunks for inline tags, plus every contribution of the other sources.

    Both parts are partial aggregates of one scan; the distinct chunks are counted after a
    ``(tag, chunk)`` aggregation, so a tag that holds a large share of the rows is spread by chunk.
    """
    rows = sources(tags)
    inline = rows.filter("origin = 'inline'").groupBy("tag", "chunk_id").agg(F.lit(1).alias("one")).groupBy("tag").agg(F.count("*").alias("n"))
    other = rows.filter("origin is null or origin <> 'inline'").groupBy("tag").agg(F.count("*").alias("n"))
    return inline.unionByName(other).groupBy("tag").agg(F.sum("n").alias("n"))


def counts_for(tags: DataFrame, names: list[str]) -> DataFrame:
    """(tag, n) of the given names, with 0 for unknown ones."""
    wanted = tags.sparkSession.createDataFrame([(n,) for n in names], "tag string")
    hit = totals(tags.filter(F.col("tag").isin(names)))
    return wanted.join(hit, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def values(tags: DataFrame, tag: str, prefix: str = "") -> DataFrame:
    """(value, n): contributions per value of one tag whose values start with ``prefix``."""
    rows = sources(tags).filter((F.col("tag") == tag) & F.col("value").startswith(prefix))
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def values_with_files(tags: DataFrame, chunk_paths: DataFrame, tag: str, prefix: str = "") -> DataFrame:
    """(value, n, paths): contributions and distinct paths per value."""
    rows = sources(tags).filter((F.col("tag") == tag) & F.col("value").startswith(prefix))
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    paths = rows.select("value", "chunk_id").join(chunk_paths, "chunk_id").filter("path is not null")
    per_value = paths.groupBy("value", "path").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("paths"))
    return counts.join(per_value, "value", "left").select("value", "n", F.coalesce("paths", F.lit(0)).alias("paths"))


def files_of(tags: DataFrame, chunk_paths: DataFrame, names: list[str]) -> DataFrame:
    """(tag, path, chunks, n): per tag and file its tagged chunks and contributions."""
    rows = sources(tags).filter(F.col("tag").isin(names)).groupBy("tag", "chunk_id").agg(F.count("*").alias("n"))
    return rows.join(chunk_paths, "chunk_id").filter("path is not null").groupBy("tag", "path").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))


def complete(tags: DataFrame, prefix: str) -> DataFrame:
    """(tag, n): names that start with ``prefix``; all of them for an empty one."""
    return totals(tags.filter(F.lower("tag").startswith(prefix.lower())))


def context_lines(chunks: DataFrame, names: list[str]) -> DataFrame:
    """(chunk_id, tag, line): lines that hold ``@name:``, from the hit on."""
    lines = chunks.filter(F.contains("text", F.lit("@"))).select("chunk_id", F.explode(F.split("text", "\n")).alias("line"))
    parts = None
    for n in names:
        at = F.instr(F.lower("line"), f"@{n.lower()}:")
        one = lines.filter(at > 0).select("chunk_id", F.lit(n).alias("tag"), T.trim_all(F.substring(F.col("line"), at, F.length("line"))).alias("line"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.distinct()


def result_tree(results: DataFrame) -> DataFrame:
    """(tag, value, n, locations, best, files) of the inline tags in results ``(chunk_id, path, text, score)``.

    Within one result every tag and value counts once; extraction is in markdown mode.
    """
    hits = results.select("chunk_id", "path", "score", F.explode(T.extract_tags(F.col("text"), F.lit(True))).alias("t"))
    rows = hits.select("chunk_id", "path", "score", F.col("t.tag").alias("tag"), F.col("t.value").alias("value")).distinct()
    return rows.groupBy("tag", "value").agg(
        F.count("*").alias("n"),
        F.max("score").alias("best"),
        F.count_distinct("path").alias("files"),
        F.array_join(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))), ",").alias("locations"),
    )


def similar_names(tags: DataFrame, least: float) -> DataFrame:
    """(a, b, score): tag names whose trigrams overlap by at least ``least``.

    Names meet through a shared trigram: rows of (gram, name) are joined on the gram, so only names that
    share one are ever compared, and the vocabulary is first reduced to distinct names.
    """
    names = tags.filter("tag is not null").select(F.lower("tag").alias("tag")).distinct().filter(F.length("tag") >= 3)
    coded = names.select("tag", T.gram_codes(F.col("tag")).alias("g"))
    flat = coded.select("tag", F.size("g").alias("size"), F.explode("g").alias("gram"))
    a, b = flat.alias("a"), flat.alias("b")
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.tag") < F.col("b.tag")))
    common = pairs.groupBy(F.col("a.tag").alias("a"), F.col("b.tag").alias("b"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb")).agg(F.count("*").alias("n"))
    score = F.round(F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")), 6)
    return common.select("a", "b", score.alias("score")).filter(F.col("score") >= least)


def dictionary(tags: DataFrame) -> DataFrame:
    """(tag, value, tvid): a stable 64-bit id per raw tag and value, without any coordination."""
    return sources(tags).select("tag", "value").distinct().withColumn("tvid", F.xxhash64("tag", "value"))


def first_value(tags: DataFrame, chunk_paths: DataFrame) -> DataFrame:
    """(path, tag, value): one value per file and tag, the smallest, inline before other sources."""
    rows = sources(tags).join(chunk_paths, "chunk_id").filter("path is not null")
    order = F.struct((F.coalesce("origin", F.lit("")) != "inline").alias("late"), F.col("value"))
    return rows.groupBy("path", "tag").agg(F.min(order).alias("m")).select("path", "tag", F.col("m.value").alias("value"))


def inbox(tags: DataFrame, chunk_paths: DataFrame, folder: str, show_all: bool = False, hidden: tuple[str, ...] = ("completed", "denied", "archived", "done")) -> DataFrame:
    """(path, status, project, topic, n_open): header fields of the files below ``folder``, open ones first.

    One value per file and tag is pivoted into columns over a fixed list of names, so no extra job
    looks for them.
    """
    names = ["status", "project", "topic", "owner"]
    one = first_value(tags.withColumn("tag", F.lower("tag")).filter(F.col("tag").isin(names)), chunk_paths.filter(F.col("path").startswith(folder)))
    wide = one.groupBy("path").pivot("tag", names).agg(F.first("value"))
    wide = wide.filter("status is not null")
    return wide if show_all else wide.filter(~F.col("status").isin(*hidden))


def top_values(tags: DataFrame, k: int) -> DataFrame:
    """(tag, value, n, rank): the ``k`` most frequent values of every tag."""
    counts = sources(tags).groupBy("tag", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)
