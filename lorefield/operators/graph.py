"""The tag graph: ``@link``/``@id`` edges, ``@ext`` targets and the tags they route.

An ``@ext`` value is a target and the tags to put on it: ``base[N]:anchor @tag: value ...``. The base is a
path, or an id behind ``%`` (``\\%`` is a literal per cent sign). ``[N]`` picks the N-th matching chunk,
``^`` the first. The anchor is a quoted string that the chunk contains, a ``/regex/`` it matches or a range
it has; without one the first chunk of the file is meant. A date, a disposition and an ``insight: "..."``
may stand before the target.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lorefield.functions import text as T
from lorefield.functions.predicates import checked_regex

LEAD = r'^\s*(?:\d{4}-\d\d-\d\d\s+)?(?:(?:accepted|rejected|pending|deferred)\s+)?(?:insight:\s+"(?:\\.|[^"\\])*"\s+)?'
TARGET = r'^(\\?%?[^:@\[\^]*?)\s*(?:\[([0-9]{1,6})\]|(\^))?\s*(?::\s*("(?:\\.|[^"\\])*"|/(?:\\.|[^/\\])*/|[^\s@"/][^\s@]*)?)?\s+(@[a-zA-Z][\w.-]*:.*)\z'
NAME = r"@([a-zA-Z][\w.-]*):"


def parse_ext(value: Column) -> Column:
    """(kind, base, nth, anchor_kind, anchor, tags, invalid), or null if there is no target or no tag."""
    body = F.regexp_replace(value, LEAD, "")
    part = lambda i: F.regexp_extract(body, TARGET, i)
    base, raw, rest = T.trim_all(part(1)), part(4), part(5)
    names = F.regexp_extract_all(rest, F.lit(NAME), F.lit(1))
    values = F.slice(F.split(rest, r"@[a-zA-Z][\w.-]*:"), 2, 1_000_000)
    tags = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda z: F.struct(F.lower(z["n"]).alias("tag"), T.trim_all(z["v"]).alias("value")))
    uuid = base.startswith("%")
    kind = F.when(uuid, "uuid").otherwise("path")
    name = F.when(uuid, F.substring(base, F.lit(2), F.length(base))).otherwise(F.replace(base, F.lit("\\%"), F.lit("%")))
    anchor_kind = F.when(raw == "", "").when(raw.startswith('"'), "string").when(raw.startswith("/"), "regex").otherwise("range")
    inner = F.when(anchor_kind.isin("string", "regex"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    anchor = F.when(anchor_kind == "string", F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(inner)
    nth = F.when(part(3) == "^", 1).when(part(2) != "", part(2).cast("int"))
    out = F.struct(
        kind.alias("kind"), name.alias("base"), nth.alias("nth"), anchor_kind.alias("anchor_kind"), anchor.alias("anchor"), tags.alias("tags"), (uuid & (anchor_kind == "range")).alias("invalid")
    )
    return F.when(body.rlike(TARGET) & (base != ""), out)


@F.pandas_udf(BooleanType())
def _compiles(pattern: pd.Series) -> pd.Series:
    """Whether patterns (few, distinct) are regular expressions that any engine reads."""

    def fine(p: str) -> bool:
        try:
            checked_regex(p)
        except (ValueError, re.error):
            return False
        return "(?P" not in p and not re.search(r"\\[ZAzGQEN]|\[[^\]]*\[", p)

    return pattern.map(fine)


def routes(tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_chunk, target_chunk, tag, value): what ``@ext`` values put on which chunks.

    Distinct targets are resolved once, by an equi-join on path and a test on the text, and joined
    back. A target in the source's own file is rejected. An id stands for the chunks that carry it. An expression that
    can't be read matches nothing.
    """
    ext = tags.filter((F.lower("tag") == "ext") & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("source_chunk"), parse_ext(F.col("value")).alias("e")).distinct()
    ext = ext.filter("e is not null and not e.invalid").select("source_chunk", "e.kind", "e.base", F.coalesce("e.nth", F.lit(0)).alias("nth"), "e.anchor_kind", "e.anchor", F.explode("e.tags").alias("t"))
    wanted = ext.select("kind", "base", "nth", "anchor_kind", "anchor").distinct()
    readable = wanted.filter("anchor_kind <> 'regex'").unionByName(wanted.filter("anchor_kind = 'regex'").filter(_compiles(F.col("anchor"))))
    body = chunks.filter("path is not null").select("chunk_id", "path", "chunk_range", "text")
    ids = tags.filter((F.lower("tag") == "id") & (F.coalesce("value", F.lit("")) != "")).select(T.trim_all(F.col("value")).alias("base"), "chunk_id").distinct()
    by_path = readable.filter("kind = 'path'").join(body.withColumnRenamed("path", "base"), "base")
    by_id = readable.filter("kind = 'uuid'").join(ids, "base").join(body.drop("path"), "chunk_id")
    rows = by_path.unionByName(by_id, allowMissingColumns=True)
    text = F.coalesce("text", F.lit(""))
    hit = (
        (F.col("anchor_kind") == "")
        | ((F.col("anchor_kind") == "string") & F.contains(text, F.col("anchor")))
        | ((F.col("anchor_kind") == "regex") & F.expr("coalesce(text, '') rlike anchor"))
        | ((F.col("anchor_kind") == "range") & (F.coalesce("chunk_range", F.lit("")) == F.col("anchor")))
    )
    w = Window.partitionBy("kind", "base", "nth", "anchor_kind", "anchor").orderBy(F.coalesce(T.range_start(F.col("chunk_range")), F.lit(1 << 40)), "chunk_id")
    # texts are only tested; repeated rows are removed without them
    tested = rows.filter(hit).select("kind", "base", "nth", "anchor_kind", "anchor", "chunk_id", "chunk_range").distinct()
    found = tested.withColumn("rn", F.row_number().over(w))
    bare = (F.col("anchor_kind") == "") & (F.col("kind") == "path")
    found = found.filter(F.when(F.col("nth") > 0, F.col("rn") == F.col("nth")).when(bare, F.col("rn") == 1).otherwise(True))
    found = found.select("kind", "base", "nth", "anchor_kind", "anchor", F.col("chunk_id").alias("target_chunk"))
    paths = chunks.select(F.col("chunk_id").alias("source_chunk"), F.col("path").alias("source_path")).distinct()
    target_paths = chunks.select(F.col("chunk_id").alias("target_chunk"), F.col("path").alias("target_path")).distinct()
    out = ext.join(found, ["kind", "base", "nth", "anchor_kind", "anchor"]).join(paths, "source_chunk", "left").join(target_paths, "target_chunk", "left")
    out = out.filter(F.col("source_path").isNull() | (F.col("source_path") != F.col("target_path")))
    return out.select("source_chunk", "target_chunk", "t.tag", "t.value").distinct()


def resolve_links(tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_chunk, value, target_chunk, path): a link's value as an id first, then as a path.

    Of several chunks with one id the smallest counts; a path stands for its smallest chunk. Links
    that resolve to nothing stay, with nulls.
    """
    clean = lambda c: T.trim_all(F.regexp_replace(F.col(c), "\u00a0", " "))
    rows = tags.filter("chunk_id is not null and value is not null")
    links = rows.filter(F.lower("tag") == "link").select(F.col("chunk_id").alias("source_chunk"), clean("value").alias("value")).filter("value <> ''").distinct()
    ids = rows.filter(F.lower("tag") == "id").select(clean("value").alias("value"), "chunk_id").filter("value <> ''").groupBy("value").agg(F.min("chunk_id").alias("by_id"))
    paths = chunks.filter("path is not null").groupBy(F.col("path").alias("value")).agg(F.min("chunk_id").alias("by_path"))
    out = links.join(ids, "value", "left").join(paths, "value", "left").withColumn("target_chunk", F.coalesce("by_id", "by_path"))
    where = chunks.filter("chunk_id is not null").groupBy(F.col("chunk_id").alias("target_chunk")).agg(F.min("path").alias("path"))
    return out.join(where, "target_chunk", "left").select("source_chunk", "value", "target_chunk", "path")


def verify_totals(tags: DataFrame, stored: DataFrame) -> DataFrame:
    """(tag, expected, stored): tags whose stored total differs from the recomputed one."""
    from lorefield.operators.tags import totals

    e = totals(tags).select("tag", F.col("n").alias("expected"))
    s = stored.select("tag", F.col("n").alias("stored"))
    out = e.join(s, "tag", "full_outer").fillna(0, ["expected", "stored"])
    return out.filter("expected <> stored")


def candidates(proposals: DataFrame) -> DataFrame:
    """(chunk_id, tag, value, tally): proposed tags with their tally, best first by window rank.

    ``proposals`` holds (chunk_id, tag, value, count, delta): a tally is at least one, and a tag whose
    judgments sum to less than zero on a chunk is hidden.
    """
    net = proposals.groupBy("chunk_id", "tag").agg(F.sum(F.coalesce("delta", F.lit(0))).alias("net"))
    tally = proposals.filter("count is not null").groupBy("chunk_id", "tag", "value").agg(F.greatest(F.sum("count"), F.lit(1)).alias("tally"))
    return tally.join(net.filter("net >= 0"), ["chunk_id", "tag"]).select("chunk_id", "tag", "value", "tally")
