"""Further rows of the survey: filter stacks, joins, write paths, scalar forms, tag graph details."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import globs
from lorefield.functions import text as T
from lorefield.functions import vectors as V
from lorefield.operators import search as S
from lorefield.operators import tags as G
from lorefield.operators import vector_search as X
from lorefield.operators.like_file import like_files
from lorefield.plans.common import Registry, chunk_tags, chunks, files, r6, vecs, vector_ids
from lorefield.plans.spec import FilterRow, SearchSpec, apply_filters, parse_stack
from lorefield.plans.tag_queries import INLINE, SRC
from lorefield.plans.vector_queries import COS, DEFS, E
from lorefield.session import read_table

R = Registry()
CH = "(SELECT DISTINCT chunk_id, path, chunk_range, text FROM chunk_results)"


def _stack(name: str, words: str, where: str) -> None:
    """A filter stack as a user types it, over all chunks."""

    def run(spark, sf):
        rows = chunks(spark, sf).filter("chunk_id is not null and path is not null")
        return apply_filters(rows, parse_stack(words.split()), read_table(spark, sf, "tag_values")).select("chunk_id").distinct()

    run.__name__ = name
    R.add(f"SELECT DISTINCT chunk_id FROM chunk_results c WHERE chunk_id IS NOT NULL AND path IS NOT NULL AND {where}")(run)


TAGGED = "SELECT chunk_id FROM tag_values WHERE chunk_id IS NOT NULL AND"
_stack("q037_contains_filter", "-contains digest", "coalesce(contains(lower(text), 'digest'), true)")
_stack("q037_contains_without", "-without -contains digest", "coalesce(NOT contains(lower(text), 'digest'), true)")
_stack("q039_regex_filter", "-regex [0-9]{3}.entries -without -regex recall", "coalesce(regexp_matches(text, '[0-9]{3}.entries'), true) AND coalesce(NOT regexp_matches(text, 'recall'), true)")
_stack("q042_files_filter", "-files **/*.md", "regexp_matches(path, '\\.md$')")
_stack("q042_files_without", "-without -files notes/*", "NOT regexp_matches(path, '^notes/[^/]*$')")
_stack("q041_file_tag_without", "-without -file-tag status=blocked", f"path NOT IN (SELECT path FROM chunk_results WHERE path IS NOT NULL AND chunk_id IN ({TAGGED} lower(tag) = 'status' AND value = 'blocked'))")
_stack("q049_file_level_filters", "stale -file-tag project -without -file-tag mute -with -files *.md", f"coalesce(contains(lower(text), 'stale'), true) AND regexp_matches(path, '\\.md$') AND path IN (SELECT path FROM chunk_results WHERE chunk_id IN ({TAGGED} lower(tag) = 'project')) AND path NOT IN (SELECT path FROM chunk_results WHERE path IS NOT NULL AND chunk_id IN ({TAGGED} lower(tag) = 'mute'))")


@R.add("""SELECT DISTINCT chunk_id, path FROM chunk_results WHERE chunk_id IN (SELECT chunk_id FROM search_entries e JOIN chunk_results c USING (path) WHERE e.entry_id IS NOT NULL) AND coalesce(contains(lower(text), 'digest'), true)""")
def q050_post_filter_funnel(spark, sf):
    """Any candidate set goes through the stack; ids without a chunk drop out."""
    paths = read_table(spark, sf, "search_entries").filter("entry_id is not null").select("path").filter("path is not null").distinct()
    ids = chunks(spark, sf).join(paths, "path", "left_semi").select("chunk_id").filter("chunk_id is not null").distinct()
    rows = chunks(spark, sf).join(ids, "chunk_id", "left_semi")
    return apply_filters(rows, [FilterRow("contains", "digest")], chunk_tags(spark, sf)).select("chunk_id", "path").distinct()


@R.add("SELECT DISTINCT path FROM chunk_results WHERE path IS NOT NULL AND NOT regexp_matches(path, '\\.pdf$')")
def q048_default_exclude(spark, sf):
    """The default excludes apply, as the search names no globs of its own."""
    include, exclude = SearchSpec(contains="x", default_exclude=("*.pdf",)).paths()
    return chunks(spark, sf).filter(F.col("path").isNotNull() & globs.passes(F.col("path"), include, exclude)).select("path").distinct()


@R.add("SELECT DISTINCT chunk_id, path FROM chunk_results WHERE chunk_id IN (SELECT chunk_id FROM tag_values WHERE lower(tag) = 'due') ORDER BY path NULLS FIRST, chunk_id LIMIT 50")
def q079_tag_primary(spark, sf):
    """Every hit scores alike, so the cut is by path and chunk."""
    hit = chunk_tags(spark, sf).filter("lower(tag) = 'due' and chunk_id is not null").select("chunk_id").distinct()
    return chunks(spark, sf).join(hit, "chunk_id", "left_semi").select("chunk_id", "path").distinct().orderBy("path", "chunk_id").limit(50)


@R.add(f"""WITH q AS (SELECT file_id, path FROM (SELECT DISTINCT file_id, path FROM files) WHERE file_id % 50 = 0),
    w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM q JOIN {CH} USING (path)),
    t AS (SELECT chunk_id, path, len(tk) AS n, unnest(tk) AS word FROM (SELECT chunk_id, path, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS tk FROM {CH}) WHERE len(tk) > 0)
    SELECT file_id, chunk_id, score FROM (SELECT w.file_id, t.chunk_id, round(count(*) / max(t.n), 6) AS score FROM t JOIN w USING (word) JOIN q ON q.file_id = w.file_id WHERE t.path IS DISTINCT FROM q.path GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_id) <= 5""")
def q066_like_file(spark, sf):
    """Density against the words of a file, for the files whose id is divisible by 50."""
    return like_files(chunks(spark, sf), read_table(spark, sf, "files").filter("file_id % 50 = 0"), 5)


@R.add("""SELECT e.entry_id, min(c.text) AS body FROM (SELECT DISTINCT entry_id, path, chunk_range FROM search_entries) e JOIN (SELECT DISTINCT path, chunk_range, text FROM chunk_results) c ON e.path = c.path AND e.chunk_range = c.chunk_range GROUP BY e.entry_id""")
def q081_hydrate(spark, sf):
    """Chunk texts of results, by path and range."""
    e = read_table(spark, sf, "search_entries").select("entry_id", "path", "chunk_range").distinct()
    return e.join(chunks(spark, sf).select("path", "chunk_range", "text"), ["path", "chunk_range"]).groupBy("entry_id").agg(F.min("text").alias("body"))


@R.add(f"""SELECT a.tag AS grp, b.id, {COS} AS score FROM {DEFS} a, {E} b WHERE a.file_id = 1 AND {COS} > 0.2 QUALIFY row_number() OVER (PARTITION BY a.tag ORDER BY score DESC, b.id) <= 20""")
def q084_two_stage_embedding(spark, sf):
    """Only targets above a floor, the best twenty of each query."""
    w = Window.partitionBy("tag").orderBy("id")
    d = vecs(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("tag").alias("grp"), F.col("id").alias("qid"), "vec")
    return X.top_k(vecs(spark, sf), d, 20, least=0.2).select("grp", "id", r6(F.col("score")).alias("score")).filter("score > 0.2")


@R.add("""SELECT DISTINCT e.query_id, c.chunk_id FROM (SELECT DISTINCT query_id, path FROM search_entries WHERE query_id IS NOT NULL) e JOIN (SELECT DISTINCT chunk_id, path FROM chunk_results) c USING (path)""")
def q088_inner_join(spark, sf):
    e = read_table(spark, sf, "search_entries").filter("query_id is not null").select("query_id", "path").distinct()
    return e.join(chunks(spark, sf).select("chunk_id", "path").distinct(), "path").select("query_id", "chunk_id").distinct()


@R.add(f"""SELECT a.tag AS grp, a.id AS a_id, b.id AS b_id, {COS} AS score FROM {DEFS} a, {DEFS} b WHERE a.id < b.id AND {COS} > 0.1""")
def q091_theta_cosine_join(spark, sf):
    """Every definition against every other; definitions are two per tag."""
    w = Window.partitionBy("tag").orderBy("id")
    d = vecs(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    q = d.select(F.concat_ws("/", "tag", F.col("id").cast("string")).alias("grp"), F.col("id").alias("qid"), "vec")
    n = X.top_k(d.select("id", "vec"), q, 1_000_000, skip_same=True)
    out = n.select(F.split("grp", "/")[0].alias("grp"), F.split("grp", "/")[1].cast("long").alias("a_id"), F.col("id").alias("b_id"), r6(F.col("score")).alias("score"))
    return out.filter("a_id < b_id and score > 0.1")


@R.add("""WITH d AS (SELECT DISTINCT chunk_id, try_cast(regexp_extract(regexp_replace(value, '^[\\s\\x{00a0}]+', ''), '^(\\d{4}-\\d\\d-\\d\\d)', 1) AS DATE) AS day FROM tag_values WHERE lower(tag) = 'due' AND chunk_id IS NOT NULL AND value IS NOT NULL)
    SELECT d.day, count(DISTINCT d.chunk_id) AS n FROM d WHERE d.day BETWEEN DATE '2026-02-01' AND DATE '2026-04-30' GROUP BY d.day""")
def q095_interval_containment(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("lower(tag) = 'due' and chunk_id is not null and value is not null")
    d = t.select("chunk_id", D.iso_date(F.col("value")).alias("day")).distinct()
    inside = F.col("day").between(F.lit("2026-02-01").cast("date"), F.lit("2026-04-30").cast("date"))
    return d.filter(inside).groupBy("day").agg(F.count_distinct("chunk_id").alias("n"))


@R.add("""SELECT path, chunk_id FROM (SELECT path, chunk_id, row_number() OVER (PARTITION BY path ORDER BY CAST(regexp_extract(chunk_range, '^(\\d+)-', 1) AS BIGINT), chunk_id) AS rn FROM (SELECT DISTINCT path, chunk_id, chunk_range FROM chunk_results WHERE path IS NOT NULL AND regexp_full_match(chunk_range, '[0-9]{1,9}-[0-9]{1,9}'))) WHERE rn = 2""")
def q124_nth_chunk(spark, sf):
    c = chunks(spark, sf).select("path", "chunk_id", T.range_start(F.col("chunk_range")).alias("a")).filter("path is not null and a is not null").distinct()
    w = Window.partitionBy("path").orderBy("a", "chunk_id")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 2").select("path", "chunk_id")


@R.add("""SELECT path, tag, value FROM (SELECT event_id, path, lower(tag) AS tag, value, ts FROM (SELECT DISTINCT event_id, path, tag, value, ts FROM tag_events) WHERE path IS NOT NULL AND lower(tag) = 'reminder' AND ts IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1""")
def q126_current_spec(spark, sf):
    """The last specification of every path."""
    e = read_table(spark, sf, "tag_events").filter("path is not null and lower(tag) = 'reminder' and ts is not null")
    last = e.groupBy("path").agg(F.max_by(F.struct(F.lower("tag").alias("tag"), "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("path", "x.tag", "x.value")


@R.add("""SELECT session, event_id, lag(event_id) OVER (PARTITION BY session ORDER BY ts, event_id) AS previous FROM (SELECT DISTINCT event_id, session, ts FROM tag_events WHERE session IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL)""")
def q127_previous_record(spark, sf):
    e = read_table(spark, sf, "tag_events").filter("session is not null and ts is not null and event_id is not null").select("event_id", "session", "ts").distinct()
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    return e.select("session", "event_id", F.lag("event_id").over(w).alias("previous"))


@R.add("SELECT DISTINCT path FROM files WHERE path IS NOT NULL ORDER BY path")
def q133_file_listing(spark, sf):
    return files(spark, sf).select("path").filter("path is not null").orderBy("path")


@R.add(f"""SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT tag FROM {SRC} WHERE origin = 'inline') a FULL JOIN (SELECT DISTINCT tag FROM {SRC} WHERE origin = 'ext') b USING (tag) WHERE a.tag IS NULL OR b.tag IS NULL""")
def q137_set_difference(spark, sf):
    t = G.sources(chunk_tags(spark, sf))
    a = t.filter("origin = 'inline'").select("tag").distinct().withColumn("a", F.lit(1))
    b = t.filter("origin = 'ext'").select("tag").distinct().withColumn("b", F.lit(1))
    out = a.join(b, "tag", "full_outer").filter("a is null or b is null")
    return out.select("tag", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


@R.add(f"""SELECT chunk_id, tag, value, count(*) - 1 AS n FROM {SRC} GROUP BY ALL HAVING count(*) > 1""")
def q139_bag_remove_one(spark, sf):
    """What is left of repeated contributions when one of each pair is taken away."""
    t = G.sources(chunk_tags(spark, sf)).groupBy("chunk_id", "tag", "value").agg((F.count("*") - 1).alias("n"))
    return t.filter("n > 0")


@R.add(f"""SELECT chunk_id, count(*) AS n FROM {INLINE} GROUP BY chunk_id""")
def q056_tags_projection(spark, sf):
    rows = chunks(spark, sf).select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.explode(T.extract_tags(F.col("text"), F.lit(True)))).groupBy("chunk_id").agg(F.count("*").alias("n"))


TRI = "list_distinct(CASE WHEN length(tag) >= 3 THEN list_transform(range(1, length(tag) - 1), lambda i: substr(tag, CAST(i AS INTEGER), 3)) WHEN length(tag) > 0 THEN [tag] ELSE [] END)"


@R.add(f"SELECT tag, len({TRI}) AS n FROM (SELECT DISTINCT tag FROM tag_values WHERE tag IS NOT NULL)")
def q145_trigram_sets(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("tag is not null").select("tag").distinct()
    return t.select("tag", F.size(T.gram_codes(F.col("tag"))).cast("long").alias("n"))


@R.add("""SELECT value, CASE WHEN length(value) = 0 THEN 0.0 WHEN contains(lower(value), 'to') THEN round(greatest(2 / octet_length(encode(lower(value))), 0.1), 6) ELSE 0.0 END AS score FROM (SELECT DISTINCT value FROM tag_values WHERE value IS NOT NULL)""")
def q148_short_fuzzy(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("value is not null").select("value").distinct()
    return t.select("value", r6(T.fuzzy(F.lit("to"), F.col("value"))).alias("score"))


@R.add("""SELECT value, round(len(list_filter(['slow', 'rivers', 'open'], lambda w: contains(lower(value), w))) / 3, 6) AS score FROM (SELECT DISTINCT value FROM tag_values WHERE value IS NOT NULL)""")
def q149_word_overlap(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("value is not null").select("value").distinct()
    return t.select("value", r6(T.word_overlap(F.lit("slow rivers open"), F.col("value"))).alias("score"))


@R.add("SELECT tag, count(*) AS n FROM (SELECT DISTINCT chunk_id, tag, value FROM tag_values WHERE tag IS NOT NULL AND chunk_id IS NOT NULL AND contains(lower(coalesce(value, '')), 'every ')) GROUP BY tag")
def q164_recurring_specs(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("tag is not null and chunk_id is not null").select("chunk_id", "tag", "value").distinct()
    return t.filter(F.lower(F.coalesce("value", F.lit(""))).contains("every ")).groupBy("tag").agg(F.count("*").alias("n"))


@R.add("""SELECT DISTINCT path FROM chunk_results WHERE path IN (SELECT path FROM chunk_results JOIN tag_values USING (chunk_id) WHERE lower(tag) = 'topic' AND contains(lower(value), 'slow'))""")
def q175_file_matches_predicate(spark, sf):
    from lorefield.functions.predicates import parse_predicate

    ids = chunk_tags(spark, sf).filter(parse_predicate("topic:slow").on(F.col("tag"), F.col("value"))).select("chunk_id").distinct()
    return chunks(spark, sf).join(ids, "chunk_id", "left_semi").filter("path is not null").select("path").distinct()


@R.add("""SELECT DISTINCT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT c.chunk_id FROM chunk_results c JOIN tag_events e USING (path) WHERE e.session = 's0001' AND e.ts IS NOT NULL AND c.chunk_id IS NOT NULL
    AND epoch_us(TIMESTAMP '2026-06-01') // 1000000 - epoch_us(date_trunc('second', e.ts)) // 1000000 < 2592000)""")
def q205_surface_cooldown(spark, sf):
    """Chunks that weren't surfaced to a session within thirty days: an event on a chunk's path has surfaced it."""
    from datetime import datetime

    from lorefield.operators.recall import cool_down

    e = read_table(spark, sf, "tag_events").filter("session = 's0001' and ts is not null").select("path", "ts").distinct()
    surfaced = chunks(spark, sf).select("chunk_id", "path").distinct().join(e, "path")
    cands = chunks(spark, sf).select("chunk_id").filter("chunk_id is not null").distinct()
    return cool_down(cands, surfaced, datetime(2026, 6, 1), 30 * 86400)


@R.add("SELECT vec_id AS id, len(embedding) AS dims, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def q228_embedding_validate(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("dims"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@R.add("SELECT DISTINCT doc_id, lower(lang) AS lang, coalesce(source, 'none') AS source FROM documents WHERE source IS NULL OR starts_with(source, 'n')")
def q021_fetch(spark, sf):
    """Documents by a prefix of their source, or without one: the filter reaches the scan."""
    d = read_table(spark, sf, "documents").filter(F.col("source").isNull() | F.col("source").startswith("n"))
    return d.select("doc_id", F.lower("lang").alias("lang"), F.coalesce("source", F.lit("none")).alias("source")).distinct()


@R.add(None)
def q227_hashing_embedder(spark, sf):
    """A deterministic embedder for tests: words hashed to 64 signed dimensions, for any text."""
    return hashed_embedding(chunks(spark, sf), "chunk_id", "text")


def hashed_embedding(rows, key: str, text: str, dims: int = 64):
    """(key, vec): each word adds +1 or -1 to one of ``dims`` dimensions."""
    words = F.transform(T.tokens(F.col(text)), lambda w: F.xxhash64(w))

    def add(codes):
        zero = F.array_repeat(F.lit(0.0), dims)
        return F.aggregate(codes, zero, lambda v, c: F.transform(v, lambda x, i: F.when(i == F.pmod(c, F.lit(dims)), x + F.when(F.pmod(F.shiftrightunsigned(c, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(x)))

    return rows.filter(F.col(text).isNotNull()).select(key, add(words).cast("array<float>").alias("vec"))


@R.add(f"""WITH rows AS (SELECT DISTINCT chunk_id, path, chunk_range, coalesce(text, '') AS text FROM {CH} WHERE chunk_id IS NOT NULL AND path IS NOT NULL),
    mine AS (SELECT * FROM rows WHERE chunk_id % 50 = 0),
    lines AS (SELECT chunk_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM mine),
    words AS (SELECT *, regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM lines WHERE trim(line, ' ') <> ''),
    tries AS (SELECT DISTINCT chunk_id, path, line_no, n, array_to_string(w[1:n], ' ') AS anchor FROM words, (SELECT unnest(range(1, 2000)) AS n) WHERE n <= len(w)),
    free AS (SELECT * FROM tries t WHERE NOT EXISTS (SELECT 1 FROM rows o WHERE o.path = t.path AND o.chunk_id <> t.chunk_id AND contains(o.text, t.anchor))),
    best AS (SELECT chunk_id, anchor FROM free QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n, line_no, anchor) = 1)
    SELECT chunk_id, min(path) AS path, coalesce(min(anchor), min(chunk_range)) AS anchor FROM mine LEFT JOIN best USING (chunk_id) GROUP BY chunk_id""")
def q162_locators(spark, sf):
    """Anchors for the chunks whose id is divisible by 50."""
    from lorefield.operators.locator import suggest

    c = chunks(spark, sf)
    return suggest(c, c.filter("chunk_id % 50 = 0"))


_TURN = "the stale recall pass re-reads every sweep"
_TURN_GRAMS = list(dict.fromkeys(_TURN[i : i + 3] for i in range(len(_TURN) - 2)))
_TURN_SQL = "[" + ", ".join(f"'{g}'" for g in _TURN_GRAMS) + "]"
LINE_TRI = "list_distinct(CASE WHEN length(line) >= 3 THEN list_transform(range(1, length(line) - 1), lambda i: substr(lower(line), CAST(i AS INTEGER), 3)) WHEN length(line) > 0 THEN [lower(line)] ELSE [] END)"


@R.add(f"""SELECT message_id, line, max(score) AS score FROM (SELECT message_id, line, round(len(list_intersect({_TURN_SQL}, g)) / (len({_TURN_SQL}) + len(g) - len(list_intersect({_TURN_SQL}, g))), 6) AS score
    FROM (SELECT message_id, line, {LINE_TRI} AS g FROM (SELECT DISTINCT message_id, unnest(string_split(content, chr(10))) AS line FROM messages WHERE lower(role) IN ('user', 'assistant') AND message_id IS NOT NULL)) WHERE len(g) > 0)
    GROUP BY message_id, line HAVING score > 0 ORDER BY score DESC, message_id, line LIMIT 8""")
def q191_chat_funnel(spark, sf):
    """Lines of chat turns by similarity to an input, cut at the gate of eight."""
    m = read_table(spark, sf, "messages").filter(F.lower("role").isin("user", "assistant") & F.col("message_id").isNotNull())
    lines = m.select("message_id", F.explode(F.split("content", "\n")).alias("line"))
    score = r6(T.jaccard(T.literal_codes(_TURN), T.gram_codes(F.lower("line"))))
    hits = T.hits(lines, score, "message_id", "line").groupBy("message_id", "line").agg(F.max("score").alias("score"))
    return hits.orderBy(F.desc("score"), "message_id", "line").limit(8)


@R.add("""SELECT origin, count(*) AS n, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (lower(tag) = 'ext') AS ext FROM (SELECT DISTINCT chunk_id, tag, value, tvid, n, origin FROM tag_values) GROUP BY origin""")
def q201_inspect(spark, sf):
    t = chunk_tags(spark, sf)
    return t.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"), F.count(F.when(F.lower("tag") == "ext", 1)).alias("ext"))


@R.add(f"""SELECT chunk_id, count(*) AS mentions FROM (SELECT DISTINCT chunk_id, text, no, line FROM (SELECT chunk_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {CH}))
    WHERE regexp_matches(line, '@[a-zA-Z][\\w.-]*:') AND ((regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1) <> '' AND substr(regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1), length(regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1)), 1) NOT IN (' ', chr(9)))
      OR length(regexp_replace(regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1), '[^`"]', '', 'g')) % 2 = 1) GROUP BY chunk_id""")
def q141_mentions(spark, sf):
    """Lines whose first tag is only mentioned, without regard to fences."""
    rows = chunks(spark, sf).select("chunk_id", "text").distinct()
    lines = rows.select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(T.TAG_PATTERN))
    return lines.filter(T.is_mention(F.col("line"), F.lit(False), F.lit(False))).groupBy("chunk_id").agg(F.count("*").alias("mentions"))


@R.add(f"""SELECT origin, count(*) AS n FROM (SELECT DISTINCT chunk_id, tag, value, tvid, n, origin FROM tag_values WHERE origin IN ('inline', 'ext') OR (origin = 'tmp' AND chunk_id % 2 = 0)) GROUP BY origin""")
def q033_tag_write_path(spark, sf):
    """All sources are written, one is replaced in place, the table is read back."""
    from lorefield.session import scratch_path
    from lorefield.sources import store

    path = scratch_path(spark, "tags")
    rows = chunk_tags(spark, sf).filter("origin is not null")
    store.append(rows, path, "origin")
    store.replace_partitions(rows.filter("origin = 'tmp' and chunk_id % 2 = 0"), path, "origin")
    back = store.read(spark, path, "chunk_id long, tag string, value string, tvid long, n int, origin string")
    return back.groupBy("origin").agg(F.count("*").alias("n"))


@R.add("""SELECT vec_id AS id, len(embedding) AS dims FROM embeddings WHERE vec_id IN (SELECT chunk_id % (SELECT count(*) FROM embeddings) FROM chunk_results WHERE chunk_id IS NOT NULL)""")
def q035_vector_multi_get(spark, sf):
    from lorefield.sources import store

    return store.get_many(vecs(spark, sf), "id", vector_ids(spark, sf).select("id")).select("id", F.size("vec").cast("long").alias("dims"))


@R.add(f"""SELECT CAST(b.id AS VARCHAR) AS chunk, max({COS}) AS score FROM {DEFS} a, {E} b WHERE b.id % 50 = 0 GROUP BY b.id""")
def q152_max_cosine_of_set(spark, sf):
    """The best cosine over all definitions, for the chunks whose id is divisible by 50."""
    w = Window.partitionBy("tag").orderBy("id")
    defs = vecs(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select(F.lit("all").alias("grp"), "id", "vec")
    mine = vecs(spark, sf).filter("id % 50 = 0").select(F.col("id").cast("string").alias("grp"), "id", "vec")
    return X.best_pairs(mine, defs).select(F.col("grp").alias("chunk"), r6(F.col("score")).alias("score"))


@R.add(f"""SELECT a.tag AS grp, b.tag AS other, max({COS}) AS score, min(a.id) FILTER ({COS} = m) AS src FROM {DEFS} a JOIN {DEFS} b ON a.tag < b.tag JOIN (SELECT a.tag AS ta, b.tag AS tb, max({COS}) AS m FROM {DEFS} a JOIN {DEFS} b ON a.tag < b.tag GROUP BY ALL) x ON x.ta = a.tag AND x.tb = b.tag GROUP BY ALL""")
def q113_max_pair(spark, sf):
    """The best pair of definitions of every two tags, and the definition it begins at."""
    w = Window.partitionBy("tag").orderBy("id")
    d = vecs(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select(F.col("tag").alias("grp"), "id", "vec")
    return X.best_pairs(d, d).filter("grp < other").select("grp", "other", r6(F.col("score")).alias("score"), "src")


@R.add("""WITH t AS (SELECT DISTINCT session, tag, value, event_id, ts FROM (SELECT DISTINCT event_id, session, lower(tag) AS tag, value, ts FROM tag_events) WHERE session IS NOT NULL AND ts IS NOT NULL),
    g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS starts FROM t WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
    SELECT session, CAST(sum(starts) AS BIGINT) AS bursts, count(*) AS events FROM g GROUP BY session""")
def q207_debounce(spark, sf):
    """Bursts per session: events less than a day apart fire once."""
    t = read_table(spark, sf, "tag_events").filter("session is not null and ts is not null").select("session", F.lower("tag").alias("tag"), "value", "event_id", "ts").distinct()
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = us(F.col("ts")) - us(F.lag("ts").over(w))
    starts = F.when(gap.isNull() | (gap > 86_400_000_000), 1).otherwise(0)
    return t.withColumn("starts", starts).groupBy("session").agg(F.sum("starts").alias("bursts"), F.count("*").alias("events"))
