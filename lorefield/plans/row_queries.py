"""Rows of the survey that other queries only contain: each with an entry of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import globs
from lorefield.functions import text as T
from lorefield.functions import vectors as V
from lorefield.operators import events as E
from lorefield.operators import graph as H
from lorefield.operators import recall as K
from lorefield.operators import search as S
from lorefield.operators import tags as G
from lorefield.plans import event_queries as EQ
from lorefield.plans import graph_queries as GQ
from lorefield.plans import vector_queries as VQ
from lorefield.plans.common import Registry, chunk_tags, chunks, files, r6, vecs
from lorefield.plans.tag_queries import SRC
from lorefield.plans.tag_queries import R as TAG_QUERIES
from lorefield.session import read_table
from lorefield.sources import listing

R = Registry()
INBOX = TAG_QUERIES.sql["q203_inbox"]


@R.add("SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0")
def q007_unchanged(spark, sf):
    """Texts of the stored length and hash, against an index in which every fourth hash is another's."""
    d, t = read_table(spark, sf, "documents").filter("text is not null"), F.col("text")
    stored = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(t, 256))
    return d.filter(listing.change_kind(t, F.length(t), stored) == "unchanged").select("doc_id").distinct()


_GLOBS = {"notes/*": "^notes/[^/]*$", "*.md": "(^|/)[^/]*\\.md$", "specs/**": "^specs/.*$", "**/*-[0-9].*": "(^|/)[^/]*-[0-9]\\.[^/]*$"}


@R.add(" UNION ALL ".join(f"SELECT DISTINCT path, '{g}' AS glob FROM files WHERE regexp_matches(path, '{rx}')" for g, rx in _GLOBS.items()))
def q047_globs(spark, sf):
    """Which of some patterns every path matches; a pattern becomes one expression at plan time."""
    cells = F.array(*[F.when(globs.matches(F.col("path"), g), F.lit(g)) for g in _GLOBS])
    return files(spark, sf).select("path").distinct().select("path", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("glob"))


@R.add(f"SELECT chunk_id, score, 'text' AS engine FROM {VQ.FTS20} UNION ALL SELECT chunk_id, score, 'vector' FROM {VQ.VEC20}")
def q063_single_engine(spark, sf):
    """The hits of either engine alone."""
    return VQ._fts(spark, sf).withColumn("engine", F.lit("text")).unionByName(VQ._vec(spark, sf).withColumn("engine", F.lit("vector")))


@R.add("""SELECT path, coalesce(known, false) AS known, coalesce(n, 0) AS n FROM (SELECT DISTINCT path, true AS known FROM files WHERE path IS NOT NULL) f
    FULL JOIN (SELECT path, count(DISTINCT chunk_id) AS n FROM chunk_results WHERE path IS NOT NULL GROUP BY path) c USING (path)""")
def q087_full_outer(spark, sf):
    """Files and chunk paths side by side: which files are known, and how many chunks each path has."""
    f = files(spark, sf).select("path", F.lit(True).alias("known")).filter("path is not null").distinct()
    c = chunks(spark, sf).filter("path is not null").groupBy("path").agg(F.count_distinct("chunk_id").alias("n"))
    return f.join(c, "path", "full_outer").select("path", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


@R.add("SELECT DISTINCT path FROM files WHERE path IN (SELECT path FROM chunk_results JOIN tag_values USING (chunk_id) WHERE lower(tag) = 'due')")
def q089_semi_join(spark, sf):
    due = chunk_tags(spark, sf).filter("lower(tag) = 'due'").select("chunk_id").distinct()
    paths = chunks(spark, sf).join(due, "chunk_id", "left_semi").select("path").distinct()
    return files(spark, sf).select("path").join(paths, "path", "left_semi").distinct()


@R.add("SELECT DISTINCT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM tag_values WHERE chunk_id IS NOT NULL AND tag IS NOT NULL)")
def q090_anti_join(spark, sf):
    tagged = chunk_tags(spark, sf).filter("tag is not null").select("chunk_id").distinct()
    return chunks(spark, sf).filter("chunk_id is not null").select("chunk_id").distinct().join(tagged, "chunk_id", "left_anti")


@R.add("SELECT entry_id, score FROM (SELECT DISTINCT entry_id, score FROM search_entries WHERE CAST(score AS VARCHAR) <> 'nan') ORDER BY score DESC, entry_id LIMIT 20")
def q129_score_cut(spark, sf):
    """The best twenty results of all; results without a number have no place."""
    e = read_table(spark, sf, "search_entries").filter("score < 1e300").select("entry_id", "score")
    return S.ranked(e, 20, "entry_id")


@R.add(f"SELECT path, status FROM ({INBOX}) ORDER BY status <> 'open', path LIMIT 30")
def q131_inbox_order(spark, sf):
    """The first thirty of the inbox: open ones first, then by path."""
    paths = chunks(spark, sf).select("chunk_id", "path").distinct()
    box = G.inbox(chunk_tags(spark, sf), paths, "requests/")
    return box.orderBy(F.col("status") != "open", "path").limit(30).select("path", "status")


_LINE = "'^@tag:[ \\t]+([\\w.-]+)[ \\t]+(.*)$'"
_DEFINED = f"(SELECT DISTINCT lower(regexp_extract(l, {_LINE}, 1)) AS name, regexp_extract(l, {_LINE}, 2) AS description FROM (SELECT '@tag: ' || tag || ' ' || value AS l FROM tag_values WHERE origin = 'ext' AND tag IS NOT NULL AND value IS NOT NULL) WHERE regexp_matches(l, {_LINE}))"


def _definitions(spark, sf):
    """(name, description): definition lines, written of the routed contributions and read back."""
    t = read_table(spark, sf, "tag_values").filter("origin = 'ext' and tag is not null and value is not null")
    lines = t.select(F.concat(F.lit("@tag: "), "tag", F.lit(" "), "value").alias("text"))
    return lines.select(F.explode(T.tag_definitions(F.col("text"))).alias("name", "description")).distinct()


@R.add(f"SELECT name, description FROM {_DEFINED}")
def q143_definition_extraction(spark, sf):
    return _definitions(spark, sf)


@R.add(f"SELECT name, count(*) AS n, min(description) AS first FROM {_DEFINED} WHERE name IN ('status', 'topic', 'due') GROUP BY name")
def q177_definitions_of_tags(spark, sf):
    d = _definitions(spark, sf).filter(F.col("name").isin("status", "topic", "due"))
    return d.groupBy("name").agg(F.count("*").alias("n"), F.min("description").alias("first"))


@R.add(f"SELECT value, round({GQ._jac('slow rivers', 0)}, 6) AS score FROM (SELECT value, {GQ._grams_of('value')} AS g FROM (SELECT DISTINCT value FROM tag_values WHERE value IS NOT NULL AND value <> '')) WHERE round({GQ._jac('slow rivers', 0)}, 6) > 0")
def q146_trigram_jaccard(spark, sf):
    """Distinct values by their similarity to one text."""
    t = read_table(spark, sf, "tag_values").filter("value <> ''").select("value").distinct()
    return T.hits(t, r6(T.jaccard(T.literal_codes("slow rivers"), T.gram_codes(F.lower("value")))), "value")


@R.add(f"SELECT b.id, {VQ.COS} AS score FROM {VQ.E} a, {VQ.E} b WHERE a.id = 1")
def q150_cosine(spark, sf):
    v = vecs(spark, sf)
    q = v.filter("id = 1").select(F.lit(1).alias("k"), F.col("vec").alias("q"))
    return v.withColumn("k", F.lit(1)).join(F.broadcast(q), "k").select("id", r6(V.cosine(F.col("q"), F.col("vec"))).alias("score"))  # one row


@R.add("SELECT DISTINCT value, try_cast(regexp_extract(regexp_replace(value, '^[\\s\\x{00a0}]+', ''), '^(\\d{4}-\\d\\d-\\d\\d)', 1) AS DATE) AS day FROM tag_values WHERE lower(tag) = 'due' AND value IS NOT NULL")
def q154_iso_dates(spark, sf):
    """The dates that values begin with; null for none and for impossible ones."""
    t = read_table(spark, sf, "tag_values").filter("lower(tag) = 'due' and value is not null").select("value").distinct()
    return t.select("value", D.iso_date(F.col("value")).alias("day"))


@R.add("SELECT DISTINCT chunk_id, replace(replace(preview, '\\', '\\\\'), '\"', '\\\"') AS anchor FROM chunk_results WHERE preview IS NOT NULL")
def q165_anchor_escape(spark, sf):
    c = chunks(spark, sf).filter("preview is not null")
    return c.select("chunk_id", T.escape_anchor(F.col("preview")).alias("anchor")).distinct()


@R.add(f"""SELECT DISTINCT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL AND (chunk_id IN (SELECT chunk_id FROM {SRC} WHERE {GQ.TALKED}) OR chunk_id NOT IN (SELECT chunk_id FROM {SRC}))""")
def q189_discussed_exclusion(spark, sf):
    """All chunks but those whose every tag has been discussed."""
    discussed = spark.createDataFrame([("status", "open"), ("project", None)], "tag string, value string")
    cands = chunks(spark, sf).select("chunk_id").filter("chunk_id is not null").distinct()
    return K.exclude_discussed(cands, G.sources(chunk_tags(spark, sf)), discussed)


@R.add("SELECT DISTINCT chunk_id, path FROM chunk_results WHERE chunk_id IS NOT NULL AND regexp_matches(path, '^notes/[^/]*$|\\.jsonl$') AND NOT regexp_matches(path, '\\.pdf$')")
def q190_path_scope(spark, sf):
    """The chunks a recall may admit under a path scope."""
    rows = chunks(spark, sf).filter("chunk_id is not null and path is not null")
    return rows.filter(globs.passes(F.col("path"), ["notes/*", "*.jsonl"], ["*.pdf"])).select("chunk_id", "path").distinct()


@R.add(f"SELECT target_chunk, count(*) AS routings, count(DISTINCT source_chunk) AS sources FROM ({GQ.R.sql['q193_ext_routing']}) GROUP BY target_chunk")
def q195_ext_provenance(spark, sf):
    """What has been routed to a chunk, and from how many."""
    routes = H.routes(read_table(spark, sf, "tag_values"), chunks(spark, sf))
    return routes.groupBy("target_chunk").agg(F.count("*").alias("routings"), F.count_distinct("source_chunk").alias("sources"))


@R.add("SELECT DISTINCT doc_id, substr(text, CAST(length(text) // 2 AS BIGINT) + 1) AS tail FROM documents WHERE text IS NOT NULL")
def q206_appended_tail(spark, sf):
    """What texts have behind the half that is indexed."""
    d, t = read_table(spark, sf, "documents").filter("text is not null"), F.col("text")
    return d.select("doc_id", listing.appended(t, F.floor(F.length(t) / 2)).alias("tail")).distinct()


@R.add(f"SELECT path, tag, arg_max(value, event_id) AS value, max(event_id) AS event_id, min(event_id) AS first_seen FROM {EQ.MATCH} WHERE subscriber = 's0001' AND path IS NOT NULL GROUP BY path, tag")
def q213_listen(spark, sf):
    """A subscriber's queue, drained at once and compressed to the latest event per path and tag."""
    mine = E.match(EQ._events(spark, sf), EQ.SUBS).filter("subscriber = 's0001' and path is not null")
    return E.compress(mine).select("path", "tag", "value", "event_id", "first_seen")


@R.add(f"SELECT subscriber, event_id FROM {EQ.MATCH} QUALIFY row_number() OVER (PARTITION BY subscriber ORDER BY event_id) <= 100")
def q214_bounded_queue(spark, sf):
    """The events a queue of a hundred holds before it is drained; later ones would be dropped."""
    w = Window.partitionBy("subscriber").orderBy("event_id")
    hits = E.match(EQ._events(spark, sf), EQ.SUBS).withColumn("rn", F.row_number().over(w))
    return hits.filter("rn <= 100").select("subscriber", "event_id")
