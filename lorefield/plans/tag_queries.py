"""Tag vocabulary, aggregation and inbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.functions import text as T
from lorefield.operators import tags as G
from lorefield.plans.common import Registry, chunk_tags, chunks, files
from lorefield.session import read_table

R = Registry()
TV = "(SELECT DISTINCT chunk_id, tag, value, tvid, n, origin FROM tag_values)"
SRC = f"(SELECT chunk_id, tag, coalesce(value, '') AS value, tvid, n AS cnt, origin FROM {TV} WHERE tag IS NOT NULL AND chunk_id IS NOT NULL)"
PATHS = "(SELECT DISTINCT chunk_id, path FROM chunk_results)"
TOTALS = f"""SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT tag, count(DISTINCT chunk_id) AS n FROM {SRC} WHERE origin = 'inline' GROUP BY tag
    UNION ALL SELECT tag, count(*) FROM {SRC} WHERE origin IS NULL OR origin <> 'inline' GROUP BY tag) GROUP BY tag"""


def _paths(spark, sf):
    return chunks(spark, sf).select("chunk_id", "path").distinct()


@R.add(TOTALS)
def q099_tag_totals(spark, sf):
    return G.totals(chunk_tags(spark, sf))


@R.add(f"""SELECT w.tag, coalesce(n, 0) AS n FROM (SELECT unnest(['status', 'project', 'no-such-tag', 'due']) AS tag) w LEFT JOIN ({TOTALS}) t USING (tag)""")
def q100_tag_counts(spark, sf):
    return G.counts_for(chunk_tags(spark, sf), ["status", "project", "no-such-tag", "due"])


@R.add("""SELECT chunk_id, tag, count(*) AS n FROM (SELECT chunk_id, lower(unnest(regexp_extract_all(text, '@([a-zA-Z][\\w.-]*):', 1))) AS tag FROM (SELECT DISTINCT chunk_id, text FROM chunk_results)) GROUP BY ALL""")
def q101_tag_occurrences(spark, sf):
    rows = chunks(spark, sf).select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.explode(T.count_tags(F.col("text"))).alias("tag")).groupBy("chunk_id", "tag").agg(F.count("*").alias("n"))


@R.add(f"SELECT value, count(*) AS n FROM {SRC} WHERE tag = 'topic' AND starts_with(value, 's') GROUP BY value")
def q102_tag_values(spark, sf):
    return G.values(chunk_tags(spark, sf), "topic", "s")


@R.add(f"SELECT value, count(DISTINCT (chunk_id, tvid, cnt, origin)) AS n, count(DISTINCT path) AS paths FROM {SRC} LEFT JOIN {PATHS} USING (chunk_id) WHERE tag = 'status' GROUP BY value")
def q103_values_with_files(spark, sf):
    return G.values_with_files(chunk_tags(spark, sf), _paths(spark, sf), "status")


@R.add(f"""SELECT tag, path, count(DISTINCT chunk_id) AS chunks, CAST(sum(m) AS BIGINT) AS n FROM (SELECT tag, chunk_id, count(*) AS m FROM {SRC} WHERE tag IN ('status', 'project') GROUP BY ALL) JOIN {PATHS} USING (chunk_id) WHERE path IS NOT NULL GROUP BY ALL""")
def q104_files_per_tag(spark, sf):
    return G.files_of(chunk_tags(spark, sf), _paths(spark, sf), ["status", "project"])


@R.add("""SELECT DISTINCT chunk_id, tag, regexp_replace(substr(line, instr(lower(line), '@' || tag || ':')), '^\\s+|\\s+$', '', 'g') AS line
    FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM chunk_results), (SELECT unnest(['decision', 'status']) AS tag) WHERE contains(lower(line), '@' || tag || ':')""")
def q105_tag_context(spark, sf):
    return G.context_lines(chunks(spark, sf).select("chunk_id", "text"), ["decision", "status"])


#: Inline tags of chunk texts in SQL: line state by a window, then the mention test.
INLINE = """(
    SELECT chunk_id, path, score, no, lower(regexp_extract(line, '@([a-zA-Z][\\w.-]*):[ \\t]*([^\\n]*)', 1)) AS tag,
        regexp_replace(regexp_extract(line, '@([a-zA-Z][\\w.-]*):[ \\t]*([^\\n]*)', 2), '^\\s+|\\s+$', '', 'g') AS value
    FROM (SELECT *, CASE WHEN starts_with(ltrim(line, ' '), '```') THEN true ELSE fences % 2 = 1 END AS fenced, regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1) AS pre
        FROM (SELECT *, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, text ORDER BY no) AS fences
            FROM (SELECT chunk_id, path, score, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM (SELECT DISTINCT chunk_id, path, 0.5 AS score, text FROM chunk_results WHERE text IS NOT NULL))))
    WHERE regexp_matches(line, '@[a-zA-Z][\\w.-]*:')
      AND (pre = '' OR substr(pre, length(pre), 1) IN (' ', chr(9)))
      AND length(regexp_replace(pre, '[^`"]', '', 'g')) % 2 = 0
      AND NOT fenced AND NOT starts_with(line, chr(9)) AND NOT starts_with(line, '    '))"""


@R.add(f"SELECT chunk_id, no AS line, tag, value FROM {INLINE}")
def q140_extract_tags(spark, sf):
    rows = chunks(spark, sf).select("chunk_id", "text").distinct()
    out = rows.select("chunk_id", F.explode(T.extract_tags(F.col("text"), F.lit(True))).alias("t"))
    return out.select("chunk_id", F.col("t.line").cast("long").alias("line"), "t.tag", "t.value")


@R.add(f"""SELECT tag, value, count(*) AS n, max(score) AS best, count(DISTINCT path) AS files, string_agg(DISTINCT CAST(chunk_id AS VARCHAR), ',' ORDER BY CAST(chunk_id AS VARCHAR)) AS locations
    FROM (SELECT DISTINCT chunk_id, path, CAST(score AS DOUBLE) AS score, tag, value FROM {INLINE} WHERE chunk_id IS NOT NULL) GROUP BY tag, value""")
def q106_result_tag_tree(spark, sf):
    """The tags of a result set that holds all chunks."""
    rows = chunks(spark, sf).filter("chunk_id is not null").select("chunk_id", "path", "text", F.lit(0.5).alias("score")).distinct()
    return G.result_tree(rows)


@R.add(f"""SELECT path, tag, value FROM (SELECT path, tag, value, row_number() OVER (PARTITION BY path, tag ORDER BY coalesce(origin, '') <> 'inline', value) AS rn FROM {SRC} JOIN {PATHS} USING (chunk_id) WHERE path IS NOT NULL) WHERE rn = 1""")
def q173_file_tag_values(spark, sf):
    return G.first_value(chunk_tags(spark, sf), _paths(spark, sf))


@R.add(f"SELECT DISTINCT tag, value FROM {SRC} WHERE chunk_id IN (SELECT chunk_id FROM chunk_results WHERE path = 'chats/daily-log.jsonl')")
def q173_file_tags(spark, sf):
    hit = chunks(spark, sf).filter("path = 'chats/daily-log.jsonl'").select("chunk_id").distinct()
    return G.sources(chunk_tags(spark, sf)).join(hit, "chunk_id", "left_semi").select("tag", "value").distinct()


@R.add(f"SELECT DISTINCT tag FROM {SRC} WHERE contains(lower(tag), 'de') AND contains(lower(tag), 'ci')")
def q174_name_token_match(spark, sf):
    t = F.lower("tag")
    return G.sources(chunk_tags(spark, sf)).filter(F.contains(t, F.lit("de")) & F.contains(t, F.lit("ci"))).select("tag").distinct()


@R.add(f"SELECT DISTINCT chunk_id FROM {SRC} WHERE tag = 'topic' AND contains(lower(value), 'slow')")
def q174_value_token_match(spark, sf):
    return G.sources(chunk_tags(spark, sf)).filter((F.col("tag") == "topic") & F.contains(F.lower("value"), F.lit("slow"))).select("chunk_id").distinct()


@R.add(f"SELECT chunk_id, origin, cnt AS n FROM {SRC} WHERE tag = 'status' AND value = 'open'")
def q176_chunks_for_value(spark, sf):
    return G.sources(chunk_tags(spark, sf)).filter("tag = 'status' and value = 'open'").select("chunk_id", "origin", "n")


@R.add(f"SELECT tag, n FROM ({TOTALS}) WHERE starts_with(lower(tag), 'de')")
def q178_tag_completion(spark, sf):
    return G.complete(chunk_tags(spark, sf), "de")


@R.add(f"""WITH names AS (SELECT DISTINCT lower(tag) AS tag FROM tag_values WHERE tag IS NOT NULL AND length(lower(tag)) >= 3),
    g AS (SELECT tag, list_distinct(list_transform(range(1, length(tag) - 1), lambda i: substr(tag, CAST(i AS INTEGER), 3))) AS g FROM names),
    p AS (SELECT x.tag AS a, y.tag AS b, len(list_intersect(x.g, y.g)) AS n, len(x.g) AS sa, len(y.g) AS sb FROM g x JOIN g y ON x.tag < y.tag)
    SELECT a, b, round(n / (sa + sb - n), 6) AS score FROM p WHERE n > 0 AND round(n / (sa + sb - n), 6) >= 0.4""")
def q153_typo_candidates(spark, sf):
    return G.similar_names(chunk_tags(spark, sf), 0.4)


@R.add(f"SELECT count(*) AS pairs, count(DISTINCT tag) AS tags FROM (SELECT DISTINCT tag, value FROM {SRC})")
def q034_dictionary(spark, sf):
    d = G.dictionary(chunk_tags(spark, sf))
    return d.agg(F.count_distinct("tvid").alias("pairs"), F.count_distinct("tag").alias("tags"))


@R.add(f"""SELECT tag, value, n, rank FROM (SELECT tag, value, count(*) AS n, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, value) AS rank FROM {SRC} GROUP BY tag, value) WHERE rank <= 3""")
def q122_top_values_per_tag(spark, sf):
    return G.top_values(chunk_tags(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@R.add(f"""WITH v AS (SELECT path, tag, value FROM (SELECT path, lower(tag) AS tag, value, row_number() OVER (PARTITION BY path, lower(tag) ORDER BY coalesce(origin, '') <> 'inline', value) AS rn FROM {SRC} JOIN {PATHS} USING (chunk_id)
      WHERE starts_with(path, 'requests/') AND lower(tag) IN ('status', 'project', 'topic', 'owner')) WHERE rn = 1),
    w AS (SELECT path, max(value) FILTER (tag = 'status') AS status, max(value) FILTER (tag = 'project') AS project, max(value) FILTER (tag = 'topic') AS topic, max(value) FILTER (tag = 'owner') AS owner FROM v GROUP BY path)
    SELECT * FROM w WHERE status IS NOT NULL AND status NOT IN ('completed', 'denied', 'archived', 'done')""")
def q203_inbox(spark, sf):
    return G.inbox(chunk_tags(spark, sf), _paths(spark, sf), "requests/")


@R.add(f"""WITH v AS (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY coalesce(origin, '') <> 'inline', value) AS rn FROM {SRC} JOIN {PATHS} USING (chunk_id) WHERE starts_with(path, 'requests/') AND lower(tag) = 'status')
    SELECT value AS status, count(*) AS n FROM v WHERE rn = 1 GROUP BY value""")
def q117_inbox_counts(spark, sf):
    box = G.inbox(chunk_tags(spark, sf), _paths(spark, sf), "requests/", show_all=True)
    return box.groupBy("status").agg(F.count("*").alias("n"))


@R.add(f"""SELECT origin, count(*) AS rows, count(DISTINCT chunk_id) AS chunks, count(DISTINCT (tag, value)) AS pairs FROM {SRC} GROUP BY origin""")
def q134_union_of_sources(spark, sf):
    """Each source's share in the union that every tag read returns."""
    rows = G.sources(chunk_tags(spark, sf))
    return rows.groupBy("origin").agg(F.count("*").alias("rows"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("tag", "value").alias("pairs"))


@R.add(f"""SELECT path FROM {PATHS} JOIN {SRC} USING (chunk_id) WHERE tag = 'project' AND path IS NOT NULL INTERSECT SELECT path FROM {PATHS} JOIN {SRC} USING (chunk_id) WHERE tag = 'topic'""")
def q135_intersect(spark, sf):
    rows = G.sources(chunk_tags(spark, sf)).join(_paths(spark, sf), "chunk_id").filter("path is not null")
    return rows.filter("tag = 'project'").select("path").intersect(rows.filter("tag = 'topic'").select("path"))


@R.add(f"""SELECT path FROM {PATHS} JOIN {SRC} USING (chunk_id) WHERE tag = 'project' AND path IS NOT NULL EXCEPT SELECT path FROM {PATHS} JOIN {SRC} USING (chunk_id) WHERE tag = 'mute'""")
def q136_except(spark, sf):
    rows = G.sources(chunk_tags(spark, sf)).join(_paths(spark, sf), "chunk_id").filter("path is not null")
    return rows.filter("tag = 'project'").select("path").subtract(rows.filter("tag = 'mute'").select("path"))


@R.add(f"""SELECT tag, value FROM {SRC} WHERE origin = 'tmp' EXCEPT SELECT tag, value FROM {SRC} WHERE origin = 'inline'""")
def q138_new_pairs(spark, sf):
    """Pairs of the overlay that the indexed sources don't have: an anti-join, null-safe by construction."""
    rows = G.sources(chunk_tags(spark, sf))
    new, old = rows.filter("origin = 'tmp'").select("tag", "value").distinct(), rows.filter("origin = 'inline'").select("tag", "value").distinct()
    return new.join(old, ["tag", "value"], "left_anti")


@R.add(f"""SELECT DISTINCT chunk_id, tag, value, origin FROM {SRC} WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL)""")
def q032_orphan_tags(spark, sf):
    known = chunks(spark, sf).select("chunk_id").filter("chunk_id is not null").distinct()
    return G.sources(chunk_tags(spark, sf)).join(known, "chunk_id", "left_anti").select("chunk_id", "tag", "value", "origin").distinct()


@R.add("""SELECT strategy, count(*) AS n, min(size) AS least, max(size) AS most, CAST(floor(sum(size) / count(*)) AS BIGINT) AS mean,
      list_sort(list(size))[CAST(floor(0.50 * (count(*) - 1)) AS BIGINT) + 1] AS p50, list_sort(list(size))[CAST(floor(0.90 * (count(*) - 1)) AS BIGINT) + 1] AS p90, list_sort(list(size))[CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99
    FROM (SELECT CASE WHEN g = 0 THEN 'all' ELSE strategy END AS strategy, size FROM (SELECT unnest([0, 1]) AS g), (SELECT c.chunk_id, coalesce(strategy, 'none') AS strategy, length(text) AS size FROM (SELECT DISTINCT chunk_id, path, text FROM chunk_results WHERE text IS NOT NULL) c LEFT JOIN (SELECT DISTINCT path, strategy FROM files) f USING (path))) GROUP BY strategy""")
def q107_chunk_stats(spark, sf):
    """Sizes per strategy and overall, with floor-index percentiles from a size histogram.

    The exact percentile comes from cumulated counts per distinct size, so no group's sizes are
    gathered in one row.
    """
    from lorefield.operators.stats import size_statistics

    rows = chunks(spark, sf).filter("text is not null").select("chunk_id", "path", F.length("text").alias("size"), F.xxhash64("text").alias("h")).distinct()
    rows = rows.join(files(spark, sf).select("path", "strategy"), "path", "left")
    return size_statistics(rows.select(F.coalesce("strategy", F.lit("none")).alias("strategy"), "size"), "strategy", "size", (0.5, 0.9, 0.99))


@R.add("""SELECT (SELECT count(DISTINCT file_id) FROM files) AS files, (SELECT count(DISTINCT file_id) FROM files WHERE status = 'stale') AS stale, (SELECT count(DISTINCT file_id) FROM files WHERE status = 'missing') AS missing,
      (SELECT count(DISTINCT chunk_id) FROM chunk_results) AS chunks, (SELECT count(DISTINCT tag) FROM tag_values) AS tags""")
def q108_status(spark, sf):
    from functools import reduce

    f = read_table(spark, sf, "files")
    one = f.agg(F.count_distinct("file_id").alias("files"), F.count_distinct(F.when(F.col("status") == "stale", F.col("file_id"))).alias("stale"), F.count_distinct(F.when(F.col("status") == "missing", F.col("file_id"))).alias("missing"))
    two = chunks(spark, sf).agg(F.count_distinct("chunk_id").alias("chunks"))
    three = read_table(spark, sf, "tag_values").agg(F.count_distinct("tag").alias("tags"))
    # each side is a single row, keyed by a constant
    keyed = [x.withColumn("k", F.lit(1)) for x in (one, two, three)]
    return reduce(lambda a, b: a.join(b, "k"), keyed).drop("k")


@R.add("""SELECT w.class, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes FROM (SELECT unnest(['inline', 'ext', 'tmp', 'unknown']) AS class) w
    LEFT JOIN (SELECT origin AS class, count(*) AS n, CAST(sum(octet_length(encode(coalesce(value, '')))) AS BIGINT) AS bytes FROM (SELECT DISTINCT chunk_id, tag, value, tvid, n, origin FROM tag_values) GROUP BY origin) t USING (class)""")
def q109_record_counts(spark, sf):
    wanted = spark.createDataFrame([(c,) for c in ("inline", "ext", "tmp", "unknown")], "class string")
    got = chunk_tags(spark, sf).groupBy(F.col("origin").alias("class")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("value", F.lit("")))).alias("bytes"))
    return wanted.join(got, "class", "left").fillna(0, ["n", "bytes"])


@R.add("""SELECT file_id, count(DISTINCT chunk_num) AS chunks FROM search_entries WHERE file_id IS NOT NULL GROUP BY file_id""")
def q110_chunks_per_file(spark, sf):
    return read_table(spark, sf, "search_entries").filter("file_id is not null").groupBy("file_id").agg(F.count_distinct("chunk_num").alias("chunks"))
