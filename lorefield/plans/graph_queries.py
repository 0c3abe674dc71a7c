"""Graph resolution, recall, expansion and proposal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorefield.functions import text as T
from lorefield.functions import vectors as V
from lorefield.operators import graph as H
from lorefield.operators import recall as K
from lorefield.operators import tags as G
from lorefield.plans.common import Registry, chunk_tags, chunks, files, r6, vecs, vector_ids
from lorefield.plans.tag_queries import SRC, TOTALS
from lorefield.session import read_table

R = Registry()
CH = "(SELECT DISTINCT chunk_id, path, chunk_range, text FROM chunk_results)"
INPUTS = ["the stale recall pass re-reads every sweep", "our weekly digest keeps the hidden preview"]


def _lead(v: str) -> str:
    return f"regexp_replace({v}, '^\\s*(?:\\d{{4}}-\\d\\d-\\d\\d\\s+)?(?:(?:accepted|rejected|pending|deferred)\\s+)?(?:insight:\\s+\"(?:\\\\.|[^\"\\\\])*\"\\s+)?', '')"


_TARGET = H.TARGET
EXT = f"""(SELECT chunk_id AS source_chunk, b, regexp_replace(regexp_extract(b, '{_TARGET}', 1), '^\\s+|\\s+$', '', 'g') AS base, regexp_extract(b, '{_TARGET}', 4) AS raw, regexp_extract(b, '{_TARGET}', 5) AS rest
    FROM (SELECT DISTINCT chunk_id, {_lead('value')} AS b FROM tag_values WHERE lower(tag) = 'ext' AND chunk_id IS NOT NULL AND value IS NOT NULL) WHERE regexp_matches(b, '{_TARGET}'))"""


@R.add(f"""SELECT source_chunk, base, CASE WHEN raw = '' THEN '' WHEN starts_with(raw, '"') THEN 'string' WHEN starts_with(raw, '/') THEN 'regex' ELSE 'range' END AS anchor_kind,
    lower(regexp_extract(rest, '@([a-zA-Z][\\w.-]*):', 1)) AS first_tag, len(regexp_extract_all(rest, '@([a-zA-Z][\\w.-]*):', 1)) AS n_tags FROM {EXT} WHERE base <> ''""")
def q160_parse_ext(spark, sf):
    rows = read_table(spark, sf, "tag_values").filter((F.lower("tag") == "ext") & F.col("chunk_id").isNotNull())
    e = rows.select(F.col("chunk_id").alias("source_chunk"), H.parse_ext(F.col("value")).alias("e"), F.regexp_replace("value", H.LEAD, "").alias("b")).filter("e is not null").distinct()
    return e.select("source_chunk", "e.base", "e.anchor_kind", F.element_at("e.tags", 1)["tag"].alias("first_tag"), F.size("e.tags").cast("long").alias("n_tags"))


@R.add(f"""WITH e AS (SELECT source_chunk, base, raw, CASE WHEN raw = '' THEN '' WHEN starts_with(raw, '"') THEN 'string' WHEN starts_with(raw, '/') THEN 'regex' ELSE 'range' END AS ak,
      CASE WHEN starts_with(raw, '"') OR starts_with(raw, '/') THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS anchor, rest FROM {EXT} WHERE base <> '' AND NOT starts_with(base, '%')),
    t AS (SELECT source_chunk, base, ak, anchor, lower(unnest(regexp_extract_all(rest, '@([a-zA-Z][\\w.-]*):', 1))) AS tag, regexp_replace(unnest(list_slice(regexp_split_to_array(rest, '@[a-zA-Z][\\w.-]*:'), 2, 99)), '^\\s+|\\s+$', '', 'g') AS value FROM e),
    c AS (SELECT *, CAST(CASE WHEN regexp_full_match(chunk_range, '[0-9]{{1,9}}-[0-9]{{1,9}}') THEN regexp_extract(chunk_range, '^(\\d+)-', 1) END AS BIGINT) AS a FROM {CH} WHERE path IS NOT NULL),
    hit AS (SELECT w.*, c.chunk_id AS target_chunk, row_number() OVER (PARTITION BY w.base, w.ak, w.anchor ORDER BY coalesce(c.a, 1099511627776), c.chunk_id) AS rn FROM (SELECT DISTINCT base, ak, anchor FROM e) w JOIN c ON c.path = w.base
      AND (w.ak = '' OR (w.ak = 'string' AND contains(coalesce(c.text, ''), w.anchor)) OR (w.ak = 'range' AND coalesce(c.chunk_range, '') = w.anchor)))
    SELECT DISTINCT t.source_chunk, h.target_chunk, t.tag, t.value FROM t JOIN hit h USING (base, ak, anchor) LEFT JOIN {CH} s ON s.chunk_id = t.source_chunk
    WHERE (h.ak <> '' OR h.rn = 1) AND (s.path IS NULL OR s.path <> t.base)""")
def q193_ext_routing(spark, sf):
    return H.routes(read_table(spark, sf, "tag_values"), chunks(spark, sf))


def _clean(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\x{{00a0}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@R.add(f"""WITH l AS (SELECT DISTINCT chunk_id AS source_chunk, {_clean('value')} AS value FROM tag_values WHERE lower(tag) = 'link' AND chunk_id IS NOT NULL AND value IS NOT NULL),
    i AS (SELECT {_clean('value')} AS value, min(chunk_id) AS by_id FROM tag_values WHERE lower(tag) = 'id' AND chunk_id IS NOT NULL AND value IS NOT NULL GROUP BY 1),
    p AS (SELECT path AS value, min(chunk_id) AS by_path FROM {CH} WHERE path IS NOT NULL GROUP BY 1)
    SELECT source_chunk, value, coalesce(by_id, by_path) AS target_chunk, (SELECT min(path) FROM {CH} c WHERE c.chunk_id = coalesce(by_id, by_path)) AS path FROM l LEFT JOIN i USING (value) LEFT JOIN p USING (value) WHERE value <> ''""")
def q096_resolve_links(spark, sf):
    return H.resolve_links(read_table(spark, sf, "tag_values"), chunks(spark, sf))


@R.add(f"""WITH e AS ({TOTALS}), s AS (SELECT tag, CASE WHEN length(tag) % 5 = 0 THEN n + 1 ELSE n END AS n FROM ({TOTALS}) WHERE length(tag) % 7 <> 0)
    SELECT tag, coalesce(e.n, 0) AS expected, coalesce(s.n, 0) AS stored FROM e FULL JOIN s USING (tag) WHERE coalesce(e.n, 0) <> coalesce(s.n, 0)""")
def q200_verify_totals(spark, sf):
    """Recomputed totals against a stored table in which some are wrong or missing."""
    t = chunk_tags(spark, sf)
    stored = G.totals(t).filter("length(tag) % 7 <> 0").withColumn("n", F.when(F.length("tag") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return H.verify_totals(t, stored)


@R.add(f"""SELECT chunk_id, tag, value, greatest(sum(n), 1) AS tally FROM (SELECT chunk_id, tag, coalesce(value, '') AS value, CAST(cnt AS BIGINT) AS n FROM {SRC} WHERE origin = 'ext') p
    WHERE (SELECT 1) = 1 AND NOT EXISTS (SELECT 1 FROM {SRC} j WHERE j.origin = 'ext' AND j.chunk_id = p.chunk_id AND j.tag = p.tag AND j.tvid % 11 = 0) GROUP BY ALL""")
def q196_candidates(spark, sf):
    """Ext contributions as proposals; ids of pairs divisible by 11 count as rejections."""
    t = G.sources(chunk_tags(spark, sf)).filter("origin = 'ext'")
    delta = F.when(F.col("tvid") % 11 == 0, F.lit(-1000000)).otherwise(F.lit(0))
    return H.candidates(t.select("chunk_id", "tag", "value", F.col("n").cast("long").alias("count"), delta.alias("delta")))


def _trigram_sql(q: str) -> str:
    grams = list(dict.fromkeys(q.lower()[i : i + 3] for i in range(len(q) - 2)))
    return "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in grams) + "]"


def _grams_of(c: str) -> str:
    return f"list_distinct(CASE WHEN length({c}) >= 3 THEN list_transform(range(1, length({c}) - 1), lambda i: substr(lower({c}), CAST(i AS INTEGER), 3)) WHEN length({c}) > 0 THEN [lower({c})] ELSE [] END)"


def _jac(q: str, floor: float = 0.1) -> str:
    g = _trigram_sql(q)
    return f"CASE WHEN len(list_intersect({g}, g)) / len({g}) < {floor} THEN 0.0 ELSE len(list_intersect({g}, g)) / (len({g}) + len(g) - len(list_intersect({g}, g))) END"


E_SQL = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
RAW = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"
COS = f"round({RAW}, 6)"
NORMAL = f"round(least(1.0, greatest(0.0, ({RAW} + 1) / 2)), 6)"
OF_CHUNK = "chunk_id % (SELECT count(*) FROM embeddings)"
#: The reserved pairs of a session: one value of status, and everything of project.
TALKED = "NOT (tag = 'status' AND value = 'open') AND tag <> 'project'"
DEFINED = f"(SELECT DISTINCT tag, value AS description FROM {SRC} WHERE origin = 'ext' AND value <> '')"
TOPICS = f"(SELECT 'topic-' || label AS tag, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2)"


def _vector_sql(i: int) -> str:
    return f"(SELECT {i} AS input, c.chunk_id, {NORMAL} AS score FROM (SELECT DISTINCT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL) c JOIN {E_SQL} b ON b.id = c.{OF_CHUNK}, {E_SQL} a WHERE a.id = {i} ORDER BY score DESC, c.chunk_id LIMIT 50)"


def _text_sql(i: int) -> str:
    return f"(SELECT {i} AS input, chunk_id, max(round({_jac(INPUTS[i])}, 6)) AS score FROM (SELECT chunk_id, {_grams_of('text')} AS g FROM {CH} WHERE text IS NOT NULL) GROUP BY chunk_id HAVING score > 0 ORDER BY score DESC, chunk_id LIMIT 50)"


def _tag_sql(i: int, where: str = "true") -> str:
    best = f"(SELECT tag, value, round({_jac(INPUTS[i])}, 6) AS score FROM (SELECT tag, value, {_grams_of('value')} AS g FROM (SELECT DISTINCT tag, value FROM {SRC} WHERE value <> '' AND {where})) WHERE score > 0 ORDER BY score DESC, tag, value LIMIT 50)"
    return f"(SELECT {i} AS input, chunk_id, max(score) AS score FROM {SRC} JOIN {best} USING (tag, value) GROUP BY chunk_id)"


def _both(make, *args) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {make(i, *args)}" for i in range(len(INPUTS)))


def _merge_sql(where: str = "true") -> str:
    parts = (("vector", _both(_vector_sql)), ("trigram", _both(_text_sql)), ("tag", _both(_tag_sql, where)))
    rows = " UNION ALL ".join(f"SELECT chunk_id, score, '{axis}' AS axis FROM ({sql})" for axis, sql in parts)
    axes = ", ".join(f"coalesce(max(score) FILTER (axis = '{axis}'), 0) AS {axis}" for axis, _ in parts)
    return f"(SELECT chunk_id, {axes}, max(score) AS score FROM ({rows}) GROUP BY chunk_id)"


def _vector_hits(spark, sf):
    """The best chunks of the input vectors 0 and 1, by cosine mapped to [0, 1]."""
    v = vecs(spark, sf)
    q = v.filter("id in (0, 1)").select(F.lit(1).alias("k"), F.col("id").alias("input"), F.col("vec").alias("q"))
    scored = v.withColumn("k", F.lit(1)).join(F.broadcast(q), "k")  # two rows
    scored = scored.select(F.col("input").cast("int").alias("input"), "id", r6(V.normalised(V.cosine(F.col("q"), F.col("vec")))).alias("score"))
    return K.hits_per_input(vector_ids(spark, sf).join(scored, "id").select("input", "chunk_id", "score"), 50)


def _merged(spark, sf, discussed=None):
    tags = G.sources(chunk_tags(spark, sf))
    return K.merge_axes({"vector": K.merged(_vector_hits(spark, sf)), "trigram": K.trigram_pass(chunks(spark, sf), INPUTS, 50), "tag": K.tag_pass(tags, INPUTS, 50, discussed)})


@R.add(f"SELECT chunk_id, max(score) AS score FROM ({_both(_text_sql)}) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50")
def q147_jaccard_with_floor(spark, sf):
    return K.trigram_pass(chunks(spark, sf), INPUTS, 50).orderBy(F.desc("score"), "chunk_id").limit(50)


@R.add(f"SELECT * FROM {_merge_sql()}")
def q111_max_merge(spark, sf):
    return _merged(spark, sf)


def _candidates(spark, sf):
    from lorefield.functions import globs

    tags = G.sources(chunk_tags(spark, sf))
    discussed = spark.createDataFrame([("status", "open"), ("project", None)], "tag string, value string")
    kept = K.exclude_discussed(_merged(spark, sf, discussed), tags, discussed)
    scope = chunks(spark, sf).filter(F.col("path").isNotNull() & globs.passes(F.col("path"), [], ["*.pdf"])).groupBy("chunk_id").agg(F.min("path").alias("path"))
    return kept.join(scope, "chunk_id")


@R.add(f"""WITH m AS (SELECT * FROM {_merge_sql(TALKED)}), own AS (SELECT DISTINCT chunk_id, tag, value FROM {SRC}),
    left_over AS (SELECT DISTINCT chunk_id FROM own WHERE {TALKED}),
    p AS (SELECT chunk_id, min(path) AS path FROM chunk_results WHERE path IS NOT NULL AND NOT regexp_matches(path, '\\.pdf$') GROUP BY chunk_id)
    SELECT m.chunk_id, path, greatest(vector, trigram) AS meaning, tag AS tags FROM m JOIN p USING (chunk_id) WHERE chunk_id IN (SELECT chunk_id FROM left_over) OR chunk_id NOT IN (SELECT chunk_id FROM own)""")
def q188_candidates(spark, sf):
    """What recall allocates from: the merged passes without discussed tags, within the path scope."""
    return _candidates(spark, sf).select("chunk_id", "path", F.greatest("vector", "trigram").alias("meaning"), F.col("tag").alias("tags"))


@R.add(None)
def q188_recall(spark, sf):
    """The candidates in the grid of source and axis; the filling is sequential, so it is tested in Python."""
    c = _candidates(spark, sf).join(files(spark, sf).groupBy("path").agg(F.min("file_id").alias("file_id")), "path", "left")
    source = F.when(F.col("path").endswith(".jsonl"), "conversation").otherwise("main")
    rows = c.select(F.lit(1).cast("long").alias("request"), F.col("chunk_id").alias("key"), source.alias("source"), F.coalesce("file_id", F.lit(-1)).alias("file_id"), F.greatest("vector", "trigram").alias("meaning"), F.col("tag").alias("tags"))
    return K.allocate_per_request(rows, 3, 20).select(F.col("key").alias("chunk_id"), "cell", "score")


@R.add(f"""WITH ed AS (SELECT 'vector_ed' AS axis, b.tag, max({NORMAL}) AS score FROM {E_SQL} a, {TOPICS} b WHERE a.id IN (0, 1) GROUP BY b.tag
      UNION ALL SELECT 'trigram_ed', tag, max(greatest({', '.join(f'round({_jac(q, 0)}, 6)' for q in INPUTS)})) AS score FROM (SELECT tag, {_grams_of('description')} AS g FROM {DEFINED}) GROUP BY tag),
    hits AS (SELECT input, chunk_id, score, 'vector_ec' AS axis, row_number() OVER (PARTITION BY input ORDER BY score DESC, chunk_id) AS pos FROM ({_both(_vector_sql)})
      UNION ALL SELECT input, chunk_id, score, 'trigram_ec', 1000000 + row_number() OVER (PARTITION BY input ORDER BY score DESC, chunk_id) FROM ({_both(_text_sql)})),
    votes AS (SELECT h.*, t.tag FROM hits h JOIN (SELECT DISTINCT chunk_id, tag FROM {SRC}) t USING (chunk_id) WHERE score > 0),
    s AS (SELECT tag, axis, score FROM votes UNION ALL SELECT tag, axis, score FROM ed WHERE score > 0),
    w AS (SELECT tag, {', '.join(f"coalesce(max(score) FILTER (axis = '{n}'), 0) AS {n}" for n in ('vector_ed', 'trigram_ed', 'vector_ec', 'trigram_ec'))}, max(score) AS score FROM s GROUP BY tag),
    best AS (SELECT * FROM w ORDER BY score DESC, tag LIMIT 20),
    shown AS (SELECT DISTINCT tag, chunk_id FROM (SELECT input, tag, chunk_id, row_number() OVER (PARTITION BY input, tag ORDER BY min(pos)) AS rn FROM votes GROUP BY input, tag, chunk_id) WHERE rn <= 40)
    SELECT best.*, coalesce((SELECT array_to_string(list_sort(list(chunk_id))[1:10], ',') FROM shown WHERE shown.tag = best.tag), '') AS chunks FROM best""")
def q187_find_connections(spark, sf):
    """Tags near the inputs on four axes: vectors and trigrams, of definitions and of chunks."""
    v, tags = vecs(spark, sf), G.sources(chunk_tags(spark, sf))
    topics = v.withColumn("rn", F.row_number().over(Window.partitionBy("tag").orderBy("id"))).filter("rn <= 2").select(F.lit(1).alias("k"), "tag", "vec")
    q = v.filter("id in (0, 1)").select(F.lit(1).alias("k"), F.col("id").alias("input"), F.col("vec").alias("q"))
    by_vector = topics.join(F.broadcast(q), "k").select("input", "tag", r6(V.normalised(V.cosine(F.col("q"), F.col("vec")))).alias("score"))  # two rows
    defined = tags.filter("origin = 'ext' and value <> ''").select("tag", F.col("value").alias("description")).distinct()
    return K.connections(by_vector, K.description_similarity(defined, INPUTS), _vector_hits(spark, sf), K.trigram_hits(chunks(spark, sf), INPUTS, 50), tags, 20)


@R.add(None)
def q123_allocate_2x2(spark, sf):
    """The grid, for requests that are the search queries."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    e = read_table(spark, sf, "search_entries").filter("query_id is not null and entry_id is not null")
    source = F.when(F.coalesce("path", F.lit("")).endswith(".jsonl"), "conversation").otherwise("main")
    rows = e.select(F.col("query_id").alias("request"), F.col("entry_id").alias("key"), source.alias("source"), F.coalesce("file_id", F.lit(-1)).alias("file_id"), zero("vec_score").alias("meaning"), zero("fts_score").alias("tags")).distinct()
    return K.allocate_per_request(rows)


@R.add(f"""WITH alt AS (SELECT 'topic' AS atag, 'slow rivers' AS aval UNION ALL SELECT 'status', 'open'),
    tv AS (SELECT tag, value, count(*) AS n FROM {SRC} WHERE length(tag) >= 3 GROUP BY ALL),
    g AS (SELECT tag, value, n, atag, aval, list_distinct(list_transform(range(1, length(tag) - 1), lambda i: substr(lower(tag), CAST(i AS INTEGER), 3))) AS gt, list_distinct(list_transform(range(1, length(atag) - 1), lambda i: substr(atag, CAST(i AS INTEGER), 3))) AS ga FROM tv, alt),
    s AS (SELECT tag, value, n, atag, len(list_intersect(gt, ga)) / (len(gt) + len(ga) - len(list_intersect(gt, ga))) AS ts, len(list_filter(string_split(aval, ' '), lambda w: contains(lower(value), w))) / len(string_split(aval, ' ')) AS vs FROM g)
    SELECT atag, tag, value, n, round(ts * vs, 6) AS score FROM s WHERE ts >= 0.3 AND vs >= 0.2 AND ts * vs >= 0.15""")
def q083_expand_fuzzy(spark, sf):
    """Pairs near the alternatives: tag trigrams times value words; the alternatives are literals."""
    tv = G.sources(chunk_tags(spark, sf)).filter("length(tag) >= 3").groupBy("tag", "value").agg(F.count("*").alias("n"))
    parts = None
    for tag, value in (("topic", "slow rivers"), ("status", "open")):
        ts = T.jaccard(T.literal_codes(tag), T.gram_codes(F.lower("tag")))
        one = tv.select(F.lit(tag).alias("atag"), "tag", "value", "n", ts.alias("ts"), T.word_overlap(F.lit(value), F.col("value")).alias("vs"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.filter("ts >= 0.3 and vs >= 0.2 and ts * vs >= 0.15").select("atag", "tag", "value", "n", r6(F.col("ts") * F.col("vs")).alias("score"))


@R.add(f"""WITH d AS (SELECT 'topic-' || label AS tag, vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2),
    s AS (SELECT b.id AS chunk, a.tag, max({COS}) AS score FROM d a, {E_SQL} b WHERE b.id % 50 = 0 GROUP BY ALL)
    SELECT chunk, tag, score FROM s WHERE score >= 0.1 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = s.chunk AND 'topic-' || e.label = s.tag) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY score DESC, tag) <= 10""")
def q192_tag_proposals(spark, sf):
    """Tags near a chunk that it doesn't carry yet, for the chunks whose id is divisible by 50."""
    from lorefield.operators.vector_search import best_pairs

    v = vecs(spark, sf)
    w = Window.partitionBy("tag").orderBy("id")
    defs = v.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select(F.col("tag").alias("grp"), "id", "vec")
    mine = v.filter("id % 50 = 0").select(F.col("id").cast("string").alias("grp"), "id", "vec")
    best = best_pairs(mine, defs, digits=6).select(F.col("grp").cast("long").alias("chunk"), F.col("other").alias("tag"), r6(F.col("score")).alias("score")).filter("score >= 0.1")
    best = best.join(v.select(F.col("id").alias("chunk"), "tag"), ["chunk", "tag"], "left_anti")
    rank = Window.partitionBy("chunk").orderBy(F.desc("score"), "tag")
    return best.withColumn("rn", F.row_number().over(rank)).filter("rn <= 10").drop("rn")
