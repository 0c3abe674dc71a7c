"""Full-text, filter and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.functions import globs, predicates
from lorefield.functions import text as T
from lorefield.operators import search as S
from lorefield.plans.common import Registry, chunk_tags, chunks, files
from lorefield.session import read_table

R = Registry()
QUERY = "stale recall pass"
WORDS = S.query_words(QUERY)
GRAMS = S.query_grams(QUERY)

#: DuckDB macros as text.
C = "(SELECT DISTINCT chunk_id, path, chunk_range, score AS s0, text FROM chunk_results)"
GRAM_LIST = "[" + ", ".join(f"'{g}'" for g in GRAMS) + "]"
TRI = "list_distinct(CASE WHEN length({t}) >= 3 THEN list_transform(range(1, length({t}) - 1), lambda i: substr({t}, CAST(i AS INTEGER), 3)) WHEN length({t}) > 0 THEN [{t}] ELSE [] END)"
TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"


def tri(t: str) -> str:
    return TRI.format(t=t)


def tok(t: str) -> str:
    return TOK.format(t=t)


def _kept_sql() -> str:
    return f"""
    base AS (SELECT * FROM {C}),
    grams AS (SELECT unnest({GRAM_LIST}) AS gram),
    dfs AS (SELECT gram, count(*) FILTER (contains(lower(text), gram)) AS df, count(*) AS total FROM grams, base GROUP BY gram),
    kept0 AS (SELECT gram FROM dfs WHERE df <= 0.5 * total),
    kept AS (SELECT gram FROM kept0 UNION ALL SELECT gram FROM grams WHERE NOT EXISTS (SELECT 1 FROM kept0))"""


def _rows(spark, sf):
    return chunks(spark, sf).select("chunk_id", "path", "text")


COVERAGE_SQL = f"""WITH {_kept_sql()},
    s AS (SELECT chunk_id, round(count(*) FILTER (contains(lower(text), gram)) / count(*), 6) AS score FROM base, kept GROUP BY chunk_id, text)
    SELECT chunk_id, score FROM s WHERE score >= 1 ORDER BY score DESC, chunk_id LIMIT 20"""
OVERLAP_SQL = f"""WITH {_kept_sql()},
    s AS (SELECT chunk_id, CAST(count(*) FILTER (contains(lower(text), gram)) AS DOUBLE) AS score FROM base, kept GROUP BY chunk_id, text)
    SELECT chunk_id, score FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20"""
DENSITY_SQL = f"""SELECT chunk_id, score FROM (SELECT chunk_id, round(CASE WHEN len(tk) > 0 THEN len(list_filter(tk, lambda w: w IN ({', '.join(repr(w) for w in WORDS)}))) / len(tk) ELSE 0.0 END, 6) AS score
    FROM (SELECT chunk_id, {tok('text')} AS tk FROM {C})) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20"""
BM25_SQL = f"""WITH base AS (SELECT * FROM {C}),
    grams AS (SELECT unnest({GRAM_LIST}) AS gram),
    dfs AS (SELECT gram, count(*) FILTER (contains(lower(text), gram)) AS df, count(*) AS total FROM grams, base GROUP BY gram),
    m AS (SELECT avg(greatest(length(coalesce(text, '')) - 2, 0)) AS mean FROM base),
    tf AS (SELECT chunk_id, gram, greatest(length(text) - 2, 0) AS len, len(list_filter(range(1, length(text)), lambda i: substr(lower(text), CAST(i AS INTEGER), 3) = gram)) AS tf FROM base, grams WHERE contains(lower(text), gram)),
    s AS (SELECT chunk_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM tf JOIN dfs USING (gram), m GROUP BY chunk_id)
    SELECT chunk_id, score FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20"""
FUZZY_SQL = f"""SELECT chunk_id, score FROM (SELECT chunk_id, round(len(list_intersect({GRAM_LIST}, g)) / nullif(len({GRAM_LIST}) + len(g) - len(list_intersect({GRAM_LIST}, g)), 0), 6) AS score
    FROM (SELECT chunk_id, {tri('lower(text)')} AS g FROM {C} WHERE text IS NOT NULL)) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20"""


def _strategy(name: str):
    def run(spark, sf):
        return S.ranked(S.by_strategy(_rows(spark, sf), QUERY, name), 20).select("chunk_id", "score")

    run.__name__ = {"coverage": "q067_coverage", "density": "q068_density", "overlap": "q069_overlap", "bm25": "q070_bm25", "fuzzy": "q074_fuzzy_search"}[name]
    return run


for _name, _sql in (("coverage", COVERAGE_SQL), ("density", DENSITY_SQL), ("overlap", OVERLAP_SQL), ("bm25", BM25_SQL), ("fuzzy", FUZZY_SQL)):
    R.add(_sql)(_strategy(_name))


@R.add(f"""SELECT gram, df, total FROM (SELECT gram, count(*) FILTER (contains(lower(text), gram)) AS df, count(*) AS total FROM (SELECT unnest({GRAM_LIST}) AS gram), {C} GROUP BY gram)""")
def q082_gram_counts(spark, sf):
    return S.gram_counts(_rows(spark, sf), QUERY)


@R.add(f"""WITH {_kept_sql()} SELECT gram FROM kept""")
def q072_discriminating_grams(spark, sf):
    kept = S.discriminating(_rows(spark, sf), QUERY)
    return spark.createDataFrame([(g,) for g in kept], "gram string")


@R.add(f"""WITH cov AS ({COVERAGE_SQL}), den AS ({DENSITY_SQL.replace(QUERY, QUERY)})
    SELECT chunk_id, score, 'coverage' AS strategy FROM cov UNION ALL SELECT chunk_id, score, 'density' FROM den WHERE NOT EXISTS (SELECT 1 FROM cov)""")
def q071_escalation(spark, sf):
    return S.escalating(_rows(spark, sf), QUERY, 20).select("chunk_id", "score", "strategy")


@R.add(f"""WITH a AS (SELECT *, 'bm25' AS strategy FROM ({BM25_SQL}) UNION ALL SELECT *, 'coverage' FROM ({COVERAGE_SQL}) UNION ALL SELECT *, 'density' FROM ({DENSITY_SQL}) UNION ALL SELECT *, 'overlap' FROM ({OVERLAP_SQL}))
    SELECT chunk_id, score, CASE WHEN n > 1 THEN 'multi' ELSE first END AS strategy FROM (SELECT chunk_id, max(score) AS score, arg_max(strategy, {{'s': score, 't': strategy}}) AS first, count(*) AS n FROM a GROUP BY chunk_id) ORDER BY score DESC, chunk_id LIMIT 20""")
def q073_multi(spark, sf):
    return S.multi(_rows(spark, sf), QUERY, 20)


@R.add(None)
def q075_proximity(spark, sf):
    """Chunks that hold all query words, by the fewest words that span them; tested against brute force."""
    rows = _rows(spark, sf).select("chunk_id", S.min_span(F.col("text"), WORDS).alias("span")).filter("span is not null").distinct()
    return rows.orderBy("span", "chunk_id").limit(40).select("chunk_id", "span")


@R.add(f"SELECT chunk_id, path FROM {C} WHERE contains(lower(text), 'stale recall')")
def q064_contains(spark, sf):
    return chunks(spark, sf).filter(F.contains(F.lower("text"), F.lit("stale recall"))).select("chunk_id", "path").distinct()


@R.add(f"SELECT chunk_id FROM {C} WHERE regexp_matches(text, '[0-9]{{3}} entries') AND regexp_matches(text, 'recall|digest') AND NOT regexp_matches(text, 'sidecar')")
def q065_regex(spark, sf):
    t = F.col("text")
    return chunks(spark, sf).filter(t.rlike("[0-9]{3} entries") & t.rlike("recall|digest") & ~t.rlike("sidecar")).select("chunk_id").distinct()


@R.add(f"""SELECT chunk_id, score FROM (SELECT chunk_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(len(list_intersect(['tra','ran','ans','nsc','scr','cri','rip','ipt'], g)) / (8 + len(g) - len(list_intersect(['tra','ran','ans','nsc','scr','cri','rip','ipt'], g))), 6) END AS score
    FROM (SELECT chunk_id, text, {tri('lower(text)')} AS g FROM {C} WHERE length(text) >= 3)) WHERE score >= 0.01""")
def q038_fuzzy_filter(spark, sf):
    rows = chunks(spark, sf).filter(F.length("text") >= 3)
    return T.hits(rows, F.round(T.fuzzy(F.lit("transcript"), F.col("text")), 6), "chunk_id", least=0.009999).distinct()


@R.add(f"""SELECT DISTINCT path FROM {C} WHERE path IS NOT NULL AND regexp_matches(path, '^notes/[^/]*$|\\.jsonl$') AND NOT regexp_matches(path, 'lark')""")
def q046_path_filter(spark, sf):
    return chunks(spark, sf).filter(globs.passes(F.col("path"), ["notes/*", "**/*.jsonl"], ["**/*lark*"]) & F.col("path").isNotNull()).select("path").distinct()


@R.add("SELECT path, CASE WHEN regexp_matches(path, '\\.md$|^specs/[^/]*$') THEN 'included' WHEN regexp_matches(path, '\\.(py|pdf)$') THEN 'excluded' ELSE 'unresolved' END AS class FROM (SELECT DISTINCT path FROM files)")
def q002_classify(spark, sf):
    cls = globs.classify(F.col("path"), ["*.md", "specs/*"], ["*.{py,pdf}"])
    return read_table(spark, sf, "files").select("path").distinct().withColumn("class", F.when(F.col("path").isNull(), "unresolved").otherwise(cls))


#: A tag's clean name and value in SQL.
TAGGED = "(SELECT DISTINCT chunk_id, tag, value, tvid, n, origin FROM tag_values)"


def _predicate(name: str, text: str, where: str) -> None:
    def run(spark, sf):
        p = predicates.parse_predicate(text)
        hit = chunk_tags(spark, sf).filter(p.on(F.col("tag"), F.col("value"))).select("chunk_id").distinct()
        return chunks(spark, sf).join(hit, "chunk_id", "left_semi").select("chunk_id", "path").distinct()

    run.__name__ = name
    R.add(f"SELECT DISTINCT chunk_id, path FROM chunk_results WHERE chunk_id IN (SELECT chunk_id FROM tag_values WHERE {where})")(run)


_predicate("q040_tag_exact", "status=done", "lower(tag) = 'status' AND value = 'done'")
_predicate("q052_tag_any", "@project", "lower(tag) = 'project'")
_predicate("q052_tag_tokens", ":stat us", "contains(lower(tag), 'stat') AND contains(lower(tag), 'us')")
_predicate("q052_tag_value_tokens", "topic:slow", "lower(tag) = 'topic' AND contains(lower(value), 'slow')")
_predicate("q052_tag_regex", "~stat~^(open|done)$", "regexp_matches(tag, '(?i)stat') AND regexp_matches(value, '^(open|done)$')")
_predicate("q052_tag_empty", "mute=", "lower(tag) = 'mute' AND value = ''")


@R.add("""SELECT DISTINCT chunk_id, path FROM chunk_results WHERE chunk_id NOT IN (SELECT chunk_id FROM tag_values WHERE lower(tag) = 'project' AND chunk_id IS NOT NULL)""")
def q044_without_tag(spark, sf):
    p = predicates.parse_predicate("project")
    hit = chunk_tags(spark, sf).filter(p.on(F.col("tag"), F.col("value"))).select("chunk_id").distinct()
    return chunks(spark, sf).filter("chunk_id is not null").join(hit, "chunk_id", "left_anti").select("chunk_id", "path").distinct()


@R.add("""SELECT DISTINCT chunk_id, path FROM chunk_results WHERE path IN (SELECT path FROM chunk_results JOIN tag_values USING (chunk_id) WHERE lower(tag) = 'status' AND value = 'blocked')""")
def q041_file_tag(spark, sf):
    hit = chunk_tags(spark, sf).filter(predicates.parse_predicate("status=blocked").on(F.col("tag"), F.col("value"))).select("chunk_id").distinct()
    rows = chunks(spark, sf).select("chunk_id", "path")
    paths = rows.join(hit, "chunk_id", "left_semi").select("path").distinct()
    return rows.join(paths, "path", "left_semi").distinct()


@R.add("""SELECT DISTINCT chunk_id, path FROM chunk_results WHERE contains(lower(text), 'digest') AND NOT contains(lower(text), 'weekly') AND regexp_matches(path, '\\.md$')
    AND chunk_id IN (SELECT chunk_id FROM tag_values WHERE lower(tag) = 'topic') AND chunk_id NOT IN (SELECT chunk_id FROM tag_values WHERE lower(tag) = 'mute' AND chunk_id IS NOT NULL)""")
def q045_stacked_filters(spark, sf):
    tags = chunk_tags(spark, sf)
    on = lambda p: tags.filter(predicates.parse_predicate(p).on(F.col("tag"), F.col("value"))).select("chunk_id").distinct()
    t = F.lower("text")
    rows = chunks(spark, sf).filter(F.contains(t, F.lit("digest")) & ~F.contains(t, F.lit("weekly")) & globs.matches(F.col("path"), "*.md"))
    return rows.join(on("topic"), "chunk_id", "left_semi").join(on("mute"), "chunk_id", "left_anti").select("chunk_id", "path").distinct()


@R.add("SELECT DISTINCT message_id, conv_id, role FROM messages WHERE ts > TIMESTAMP '2026-02-01' AND ts < TIMESTAMP '2026-04-01'")
def q051_time_window(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return read_table(spark, sf, "messages").filter((ts > day("2026-02-01")) & (ts < day("2026-04-01"))).select("message_id", "conv_id", "role").distinct()


@R.add("""SELECT DISTINCT chunk_id, CAST(regexp_extract(chunk_range, '^(\\d+)-', 1) AS BIGINT) AS first_line, CAST(regexp_extract(chunk_range, '-(\\d+)$', 1) AS BIGINT) AS last_line
    FROM chunk_results WHERE regexp_full_match(chunk_range, '[0-9]{1,9}-[0-9]{1,9}')""")
def q059_range_parse(spark, sf):
    r = F.col("chunk_range")
    return chunks(spark, sf).select("chunk_id", T.range_start(r).alias("first_line"), T.range_end(r).alias("last_line")).filter("first_line is not null").distinct()


@R.add("""SELECT chunk_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS part FROM (SELECT DISTINCT chunk_id, text FROM chunk_results WHERE text IS NOT NULL)""")
def q059_line_slice(spark, sf):
    return chunks(spark, sf).filter("text is not null").select("chunk_id", T.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("part"), "text").distinct().select("chunk_id", "part")


def _preview_sql(width: int, query: str) -> str:
    return f"""SELECT DISTINCT chunk_id, CASE WHEN length(text) <= {width} THEN text ELSE CASE WHEN st + {width} - 1 < length(text) THEN regexp_replace(hd, '\\s+\\S*$', '') || '...' ELSE hd END END AS preview
    FROM (SELECT *, CASE WHEN st > 1 THEN '...' || regexp_replace(win, '^\\S*\\s+', '') ELSE win END AS hd FROM (SELECT *, substr(text, st, {width}) AS win FROM (SELECT chunk_id, text,
      CAST(greatest(1, least(greatest(1, CASE WHEN instr(lower(text), '{query}') > 0 THEN instr(lower(text), '{query}') + {len(query) // 2 - width // 2} ELSE 1 END), length(text) - {width} + 1)) AS BIGINT) AS st
      FROM chunk_results WHERE text IS NOT NULL)))"""


@R.add(_preview_sql(80, "digest"))
def q057_preview(spark, sf):
    return chunks(spark, sf).filter("text is not null").select("chunk_id", T.preview(F.col("text"), "digest", 80).alias("preview")).distinct()


@R.add("""SELECT DISTINCT chunk_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(recall|digest)', '<mark>\\1</mark>', 'g') AS html FROM chunk_results WHERE regexp_matches(text, '(?i)recall|digest')""")
def q058_highlight(spark, sf):
    return chunks(spark, sf).filter(F.col("text").rlike("(?i)recall|digest")).select("chunk_id", T.highlight(F.col("text"), "recall|digest").alias("html")).distinct()


@R.add(f"""WITH r AS ({DENSITY_SQL}), h AS (SELECT r.*, path FROM r JOIN (SELECT DISTINCT chunk_id, path FROM chunk_results) USING (chunk_id) WHERE path IN (SELECT path FROM files))
    SELECT path, max(score) AS best, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY score DESC, chunk_id) AS chunk_ids FROM h GROUP BY path""")
def q080_grouped(spark, sf):
    hits = S.ranked(S.by_strategy(_rows(spark, sf), QUERY, "density"), 20)
    return S.grouped(hits.select("chunk_id", "path", "score"), files(spark, sf))


@R.add("""WITH q AS (SELECT DISTINCT entry_id, coalesce(CASE WHEN isnan(fts_score) THEN 0 ELSE fts_score END, 0) AS f, coalesce(CASE WHEN isnan(vec_score) THEN 0 ELSE vec_score END, 0) AS v, query_id FROM search_entries)
    SELECT query_id, entry_id, round(f + v, 6) AS score FROM q WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(f + v, 6) DESC, entry_id) <= 3""")
def q061_merge_top_k(spark, sf):
    from pyspark.sql import Window

    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    rows = read_table(spark, sf, "search_entries").filter("query_id is not null")
    rows = rows.select("query_id", "entry_id", zero("fts_score").alias("f"), zero("vec_score").alias("v")).distinct()
    rows = rows.select("query_id", "entry_id", F.round(F.col("f") + F.col("v"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@R.add("""WITH e AS (SELECT DISTINCT entry_id, path, file_id FROM search_entries) SELECT e.entry_id, e.path, f.strategy, f.status FROM e JOIN (SELECT DISTINCT file_id, strategy, status FROM files) f USING (file_id)""")
def q086_chunk_to_file(spark, sf):
    e = read_table(spark, sf, "search_entries").select("entry_id", "path", "file_id").distinct()
    return e.join(files(spark, sf).select("file_id", "strategy", "status"), "file_id").select("entry_id", "path", "strategy", "status")


@R.add("""WITH e AS (SELECT DISTINCT entry_id, path, CAST(regexp_extract(chunk_range, '^(\\d+)-', 1) AS BIGINT) AS a, CAST(regexp_extract(chunk_range, '-(\\d+)$', 1) AS BIGINT) AS b FROM search_entries WHERE entry_id % 50 = 0 AND regexp_full_match(chunk_range, '[0-9]{1,9}-[0-9]{1,9}')),
    c AS (SELECT DISTINCT chunk_id, path, CAST(regexp_extract(chunk_range, '^(\\d+)-', 1) AS BIGINT) AS a, CAST(regexp_extract(chunk_range, '-(\\d+)$', 1) AS BIGINT) AS b FROM chunk_results WHERE regexp_full_match(chunk_range, '[0-9]{1,9}-[0-9]{1,9}'))
    SELECT e.entry_id, c.chunk_id FROM e JOIN c ON e.path = c.path AND e.a <= c.b AND c.a <= e.b""")
def q094_range_overlap(spark, sf):
    """Chunks whose line range overlaps an entry's, for the entries whose id is divisible by 50."""
    r = F.col("chunk_range")
    e = read_table(spark, sf, "search_entries").filter("entry_id % 50 = 0").select("entry_id", "path", T.range_start(r).alias("ea"), T.range_end(r).alias("eb")).filter("ea is not null").distinct()
    c = chunks(spark, sf).select("chunk_id", "path", T.range_start(r).alias("ca"), T.range_end(r).alias("cb")).filter("ca is not null").distinct()
    return e.join(c, "path").filter("ea <= cb and ca <= eb").select("entry_id", "chunk_id")


@R.add("""WITH c AS (SELECT DISTINCT chunk_id, path, CAST(regexp_extract(chunk_range, '^(\\d+)-', 1) AS BIGINT) AS a FROM chunk_results WHERE path IS NOT NULL AND regexp_full_match(chunk_range, '[0-9]{1,9}-[0-9]{1,9}')),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a, chunk_id) AS no FROM c)
    SELECT q.chunk_id, t.chunk_id AS near_id, CAST(t.no - q.no AS BIGINT) AS off FROM n q JOIN n t ON q.path = t.path AND t.no BETWEEN q.no - 1 AND q.no + 2 WHERE q.chunk_id % 50 = 0""")
def q021_neighbours(spark, sf):
    """One chunk before and two behind, for the chunks whose id is divisible by 50."""
    from pyspark.sql import Window

    c = chunks(spark, sf).select("chunk_id", "path", T.range_start(F.col("chunk_range")).alias("a")).filter("path is not null and a is not null").distinct()
    w = Window.partitionBy("path").orderBy("a", "chunk_id")
    before = [F.struct(F.lag("chunk_id", 1).over(w).alias("near_id"), F.lit(-1).cast("long").alias("off")), F.struct(F.col("chunk_id").alias("near_id"), F.lit(0).cast("long").alias("off"))]
    behind = [F.struct(F.lead("chunk_id", o).over(w).alias("near_id"), F.lit(o).cast("long").alias("off")) for o in (1, 2)]
    rows = c.withColumn("near", F.array(*before, *behind)).filter("chunk_id % 50 = 0")
    return rows.select("chunk_id", F.explode("near").alias("x")).select("chunk_id", "x.near_id", "x.off").filter("near_id is not null")
