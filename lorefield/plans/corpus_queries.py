"""Queries over files, documents and messages: listings, change detection, chunking, chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.functions import text as T
from lorefield.plans.common import Registry, chunks, files
from lorefield.session import read_table
from lorefield.sources import chat, chunkers, listing, sinks

R = Registry()
DOCS = "(SELECT DISTINCT doc_id, text, lang, source, n_chars, path FROM documents)"
FILES = "(SELECT DISTINCT file_id, path, strategy, file_length, hex(content_hash) AS hash, mod_time, status FROM files)"


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@R.add(f"""SELECT path, file_length AS length, CASE WHEN file_length = 0 THEN 'empty' WHEN regexp_matches(path, '\\.(md|txt)$') THEN 'included' WHEN regexp_matches(path, '^chats/[^/]*$') THEN 'excluded' ELSE 'unresolved' END AS class FROM {FILES}""")
def q001_scan(spark, sf):
    """A listing classified by rules; empty files are told apart before any rule."""
    cls = listing.globs.classify(F.col("path"), ["*.{md,txt}"], ["chats/*"])
    return files(spark, sf).select("path", F.col("file_length").alias("length"), F.when(F.col("file_length") == 0, "empty").otherwise(cls).alias("class"))


@R.add(f"""SELECT path, CASE WHEN regexp_matches(path, '^specs/[^/]*\\.md$') THEN 'paragraph' WHEN regexp_matches(path, '\\.jsonl$') THEN 'chat' WHEN regexp_matches(path, '\\.md$') THEN 'markdown' WHEN regexp_matches(path, '\\.py$') THEN 'indent' ELSE 'lines' END AS chosen FROM {FILES}""")
def q004_strategy_choice(spark, sf):
    rules = {"*.md": "markdown", "*.jsonl": "chat", "*.py": "indent", "specs/*.md": "paragraph"}
    return files(spark, sf).select("path", listing.strategy_for(F.col("path"), rules).alias("chosen"))


@R.add(f"""SELECT path, mod_time FROM {FILES} WHERE NOT EXISTS (SELECT 1 FROM {FILES} m WHERE m.file_length = 0 AND m.path = path AND m.mod_time = mod_time AND m.file_length = 0) OR file_length > 0""".replace("m.path = path AND m.mod_time = mod_time", "m.path = f.path AND m.mod_time = f.mod_time").replace(f"FROM {FILES} WHERE NOT", f"FROM {FILES} f WHERE NOT"))
def q005_empty_memo(spark, sf):
    f = files(spark, sf).select("path", F.col("mod_time").alias("mtime"), "file_length")
    memo = f.filter("file_length = 0")
    return listing.skip_known_empty(f, memo).select("path", F.col("mtime").alias("mod_time"))


#: The listing is the index with every third file grown, every fifth gone and one in seven new.
@R.add(f"""WITH i AS (SELECT path, file_length AS length, hash FROM {FILES} WHERE file_id % 7 <> 0), d AS (SELECT path, CASE WHEN file_id % 3 = 0 THEN file_length + 1 ELSE file_length END AS length, hash FROM {FILES} WHERE file_id % 5 <> 0)
    SELECT path, CASE WHEN d.path IS NULL THEN 'M' WHEN i.path IS NULL THEN 'N' WHEN i.length IS NOT DISTINCT FROM d.length AND i.hash IS NOT DISTINCT FROM d.hash THEN 'G' ELSE 'S' END AS code
    FROM i FULL JOIN d USING (path)""")
def q006_file_status(spark, sf):
    f = read_table(spark, sf, "files").select("file_id", "path", "file_length", F.hex("content_hash").alias("hash")).distinct()
    index = f.filter("file_id % 7 <> 0").select("path", F.col("file_length").alias("length"), "hash")
    now = f.filter("file_id % 5 <> 0").select("path", F.when(F.col("file_id") % 3 == 0, F.col("file_length") + 1).otherwise(F.col("file_length")).alias("length"), "hash")
    return listing.status(index, now)


@R.add(f"""SELECT doc_id, CASE WHEN length(text) = k AND sha256(text) = h THEN 'unchanged' WHEN length(text) > k AND sha256(substr(text, 1, k)) = h THEN 'append' ELSE 'changed' END AS kind
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE length(text) // 2 END AS k, CASE WHEN doc_id % 4 = 0 THEN sha256('x') WHEN doc_id % 3 = 0 THEN sha256(text) ELSE sha256(substr(text, 1, length(text) // 2)) END AS h FROM {DOCS} WHERE text IS NOT NULL)""")
def q008_change_detection(spark, sf):
    """Unchanged, appended or changed, against an index that holds part of the texts."""
    t = F.col("text")
    half = F.floor(F.length(t) / 2)
    k = F.when(F.col("doc_id") % 3 == 0, F.length(t)).otherwise(half)
    h = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("x"), 256)).when(F.col("doc_id") % 3 == 0, F.sha2(t, 256)).otherwise(F.sha2(F.substring(t, F.lit(1), half.cast("int")), 256))
    rows = _docs(spark, sf).filter("text is not null").withColumn("k", k).withColumn("h", h)
    return rows.select("doc_id", listing.change_kind(t, F.col("k"), F.col("h")).alias("kind")).distinct()


@R.add(f"""SELECT path FROM {FILES} WHERE NOT regexp_matches(path, '\\.(md|jsonl)$|^specs/[^/]*$')""")
def q010_sweep(spark, sf):
    return listing.sweep(files(spark, sf), ["*.{md,jsonl}", "specs/*"], []).select("path")


@R.add(None)
def q012_paragraph_chunks(spark, sf):
    """Paragraphs under their headings, over all documents; tested against brute force."""
    return chunkers.code_chunks(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", "paragraph").select("doc_id", "no", "location", "text")


@R.add(f"""SELECT doc_id, no, no || '-' || no AS location, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {DOCS} WHERE text IS NOT NULL) WHERE line <> ''""")
def q013_line_chunks(spark, sf):
    out = chunkers.line_chunks(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text")
    return out.withColumn("no", F.col("no").cast("long"))


@R.add(None)
def q014_bracket_chunks(spark, sf):
    return chunkers.code_chunks(chunks(spark, sf).select("chunk_id", "text"), "chunk_id", "text", "bracket")


@R.add(None)
def q014_indent_chunks(spark, sf):
    return chunkers.code_chunks(chunks(spark, sf).select("chunk_id", "text"), "chunk_id", "text", "indent")


def _chat_lines(spark, sf):
    """Messages as chat-log lines."""
    m = read_table(spark, sf, "messages").select("message_id", "role", "content", "ts").distinct()
    inner = F.struct(F.col("role").alias("role"), F.col("content").alias("content"))
    line = F.to_json(F.struct(F.lower("role").alias("type"), inner.alias("message"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp")))
    return m.select("message_id", line.alias("line"))


@R.add("""SELECT message_id, content AS text, lower(role) AS role FROM (SELECT DISTINCT message_id, role, content, ts FROM messages) WHERE lower(role) IN ('user', 'assistant') AND content IS NOT NULL AND content <> '' AND NOT starts_with(content, '[')""")
def q015_chat_chunks(spark, sf):
    """Chat-log lines, written as JSON and parsed back: turns with a text, by role."""
    rows = _chat_lines(spark, sf).filter(~F.coalesce(F.get_json_object("line", "$.message.content"), F.lit("")).startswith("["))
    return chat.chat_chunks(rows).select("message_id", "text", "role")


@R.add("""SELECT message_id, json_extract_string(content, '$.name') AS name, json_extract_string(content, '$.out') AS out FROM (SELECT DISTINCT message_id, content FROM messages WHERE starts_with(content, '{"name"')) WHERE json_valid(content)""")
def q167_json_extract(spark, sf):
    rows = read_table(spark, sf, "messages").filter(F.col("content").startswith('{"name"')).select("message_id", "content").distinct()
    rows = rows.select("message_id", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.out").alias("out"))
    return rows.filter("name is not null")


@R.add("""SELECT conv_id, turn, message_id, role FROM (SELECT DISTINCT conv_id, turn, message_id, role, ts FROM messages) WHERE conv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY message_id) = 1""")
def q016_incremental_turns(spark, sf):
    """One message per conversation and turn: a turn that was sent again keeps its first message."""
    rows = read_table(spark, sf, "messages").filter("conv_id is not null")
    first = rows.groupBy("conv_id", "turn").agg(F.min_by(F.struct("message_id", "role"), "message_id").alias("m"))
    return first.select("conv_id", "turn", "m.message_id", "m.role")


@R.add("""SELECT conv_id, count(*) AS turns, count(*) FILTER (lower(role) = 'user') AS users, max(turn) AS last_turn FROM (SELECT DISTINCT conv_id, turn, role FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id""")
def q026_transcript_summary(spark, sf):
    rows = read_table(spark, sf, "messages").filter("conv_id is not null and turn is not null").select("conv_id", "turn", "role").distinct()
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.lower("role") == "user", 1)).alias("users"), F.max("turn").alias("last_turn"))


@R.add("""SELECT path, origin, count(*) AS n FROM (SELECT DISTINCT chunk_id, path, 'index' AS origin FROM chunk_results WHERE path IS NOT NULL AND NOT starts_with(path, 'tmp://') UNION ALL SELECT DISTINCT event_id, path, 'tmp' FROM tag_events WHERE starts_with(path, 'tmp://')) GROUP BY ALL""")
def q020_overlay(spark, sf):
    """Indexed chunks and overlay documents side by side, told apart by their origin."""
    base = chunks(spark, sf).filter("path is not null and not startswith(path, 'tmp://')").select(F.col("chunk_id").alias("id"), "path").distinct().withColumn("origin", F.lit("index"))
    tmp = read_table(spark, sf, "tag_events").filter("startswith(path, 'tmp://')").select(F.col("event_id").alias("id"), "path").distinct().withColumn("origin", F.lit("tmp"))
    return base.unionByName(tmp).groupBy("path", "origin").agg(F.count("*").alias("n"))


@R.add("""SELECT DISTINCT chunk_id, chunk_range FROM chunk_results WHERE path = 'chats/daily-log.jsonl'""")
def q022_file_chunks(spark, sf):
    return chunks(spark, sf).filter("path = 'chats/daily-log.jsonl'").select("chunk_id", "chunk_range").distinct()


@R.add(f"""SELECT c.chunk_id, c.path, c.chunk_range, f.strategy, f.status, length(c.text) AS size FROM (SELECT DISTINCT chunk_id, path, chunk_range, text FROM chunk_results) c JOIN {FILES} f USING (path)""")
def q023_chunk_info(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "path", "chunk_range", F.length("text").alias("size"), F.xxhash64("text").alias("h")).distinct()
    return c.join(files(spark, sf).select("path", "strategy", "status"), "path").select("chunk_id", "path", "chunk_range", "strategy", "status", "size")


@R.add("""SELECT DISTINCT chunk_id, CASE WHEN coalesce(chunk_range, '') = '' THEN path ELSE concat_ws(':', path, chunk_range) END AS location FROM chunk_results""")
def q024_locations(spark, sf):
    return chunks(spark, sf).select("chunk_id", sinks.location(F.col("path"), F.col("chunk_range")).alias("location")).distinct()


@R.add("""SELECT DISTINCT chunk_id, '<chunk path="' || replace(replace(path, '&', '&amp;'), '"', '&quot;') || '">' || chr(10) || text || chr(10) || '</chunk>' AS xml FROM chunk_results""")
def q024_wrapped(spark, sf):
    return chunks(spark, sf).select("chunk_id", sinks.wrapped("chunk", F.col("path"), F.col("text")).alias("xml")).distinct()


@R.add(f"""SELECT path, rules, conflict FROM (SELECT path, concat_ws('|', CASE WHEN regexp_matches(path, '\\.md$') THEN 'include:*.md@user' END, CASE WHEN regexp_matches(path, '^notes/[^/]*$') THEN 'exclude:notes/*@default' END) AS rules, regexp_matches(path, '\\.md$') AND regexp_matches(path, '^notes/[^/]*$') AS conflict FROM {FILES})""")
def q028_explain_rules(spark, sf):
    return listing.explain_rules(files(spark, sf), [("include", "*.md", "user"), ("exclude", "notes/*", "default")])


@R.add("""SELECT * FROM (VALUES ('case', 'changed', 'defer'), ('tag_model', 'added', 'minimal'), ('k', 'removed', 'benign')) t(key, change, reaction)""")
def q029_config_diff(spark, sf):
    old = spark.createDataFrame([("case", "on"), ("k", "20"), ("same", "1")], "key string, value string")
    new = spark.createDataFrame([("case", "off"), ("tag_model", "x"), ("same", "1")], "key string, value string")
    return listing.diff_config(old, new)


@R.add(f"""SELECT path, CASE WHEN starts_with(path, 'notes/') THEN 'notes' WHEN starts_with(path, 'requests/') THEN 'requests' WHEN starts_with(path, 'chats/') THEN 'chats' END AS source FROM {FILES}""")
def q030_source_for_path(spark, sf):
    return listing.source_for(files(spark, sf), ["notes", "requests", "chats"])


@R.add(f"""SELECT path FROM {FILES} WHERE ends_with(path, 'daily-log.jsonl') OR ends_with(path, 'flintvault-34.jsonl')""")
def q031_session_logs(spark, sf):
    return chat.session_logs(files(spark, sf), ["daily-log", "flintvault-34"]).select("path")


@R.add(f"""SELECT path FROM {FILES} WHERE status = 'missing' AND NOT regexp_matches(path, '\\.md$')""")
def q027_missing(spark, sf):
    return listing.dismiss(files(spark, sf).filter("status = 'missing'"), "*.md").select("path")


@R.add(f"""SELECT DISTINCT path FROM chunk_results WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)""")
def q093_unresolved_paths(spark, sf):
    known = files(spark, sf).select("path").filter("path is not null")
    return chunks(spark, sf).filter("path is not null").select("path").distinct().join(known, "path", "left_anti")


@R.add(f"""SELECT doc_id, sha256(text) AS hash FROM {DOCS} WHERE text IS NOT NULL""")
def q169_content_hash(spark, sf):
    return _docs(spark, sf).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash")).distinct()


@R.add(f"""SELECT hash, count(*) AS n, min(file_id) AS first FROM {FILES} WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1""")
def q119_shared_hashes(spark, sf):
    f = files(spark, sf).filter("content_hash is not null").groupBy(F.hex("content_hash").alias("hash")).agg(F.count("*").alias("n"), F.min("file_id").alias("first"))
    return f.filter("n > 1")


@R.add(f"""SELECT path, CASE WHEN file_length < 1024 THEN printf('%d B', file_length) WHEN file_length < 1048576 THEN printf('%.1f', file_length / 1024.0) || ' KB' WHEN file_length < 1073741824 THEN printf('%.1f', file_length / 1048576.0) || ' MB' ELSE printf('%.1f', file_length / 1073741824.0) || ' GB' END AS size FROM {FILES} WHERE file_length IS NOT NULL""")
def q170_human_sizes(spark, sf):
    return files(spark, sf).filter("file_length is not null").select("path", T.human_size(F.col("file_length")).alias("size"))


@R.add("""SELECT v, CAST(string_split(v, ':')[1] AS INTEGER) AS chapter, CAST(string_split(v, ':')[2] AS INTEGER) AS verse FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(\\d{1,3}:\\d{1,3})', 1)) AS v FROM chunk_results)""")
def q166_chapter_verse(spark, sf):
    v = F.regexp_extract_all("text", F.lit(r"(\d{1,3}:\d{1,3})"), F.lit(1))
    rows = chunks(spark, sf).select(F.explode(v).alias("v")).distinct()
    return rows.select("v", T.chapter_verse(F.col("v")).alias("c")).select("v", "c.chapter", "c.verse")


#: Lines of all chunk texts, with what stands before their first tag and whether they lie in a fence.
TAG_LINES = """(SELECT *, CASE WHEN starts_with(ltrim(line, ' '), '```') THEN true ELSE fences % 2 = 1 END AS fenced, regexp_extract(line, '^(.*?)@[a-zA-Z][\\w.-]*:', 1) AS pre, regexp_matches(line, '@[a-zA-Z][\\w.-]*:') AS tagged
    FROM (SELECT *, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, text ORDER BY no) AS fences
      FROM (SELECT chunk_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM (SELECT DISTINCT chunk_id, text FROM chunk_results WHERE text IS NOT NULL))))"""


@R.add(f"""WITH l AS (SELECT *, tagged AND (pre = '' OR substr(pre, length(pre), 1) IN (' ', chr(9))) AND length(regexp_replace(pre, '[^`"]', '', 'g')) % 2 = 0 AND NOT fenced AND NOT starts_with(line, chr(9)) AND NOT starts_with(line, '    ') AS own FROM {TAG_LINES}),
    k AS (SELECT chunk_id, text AS body, no, CASE WHEN own THEN regexp_replace(line, '@([a-zA-Z][\\w.-]*):[ \\t]*([^\\n]*)', '') ELSE line END AS line FROM l WHERE NOT (own AND regexp_matches(line, '^\\s*@[a-zA-Z][\\w.-]*:')))
    SELECT t.chunk_id, coalesce(string_agg(line, chr(10) ORDER BY no), '') AS text FROM (SELECT DISTINCT chunk_id, text FROM chunk_results WHERE text IS NOT NULL) t LEFT JOIN k ON k.chunk_id IS NOT DISTINCT FROM t.chunk_id AND k.body = t.text GROUP BY t.chunk_id, t.text
    UNION ALL SELECT DISTINCT chunk_id, text FROM chunk_results WHERE text IS NULL""")
def q142_strip_tags(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.strip_tags(F.col("text"), F.lit(True)).alias("text"), F.xxhash64("text").alias("h")).distinct().select("chunk_id", "text")


@R.add(f"""WITH l AS (SELECT *, min(CASE WHEN NOT regexp_matches(line, '^@([a-zA-Z][\\w.-]*):') THEN no END) OVER (PARTITION BY chunk_id, text) AS stop FROM {TAG_LINES})
    SELECT DISTINCT chunk_id, lower(regexp_extract(line, '^@([a-zA-Z][\\w.-]*):', 1)) AS name, regexp_replace(regexp_extract(line, '^@[a-zA-Z][\\w.-]*:[ \\t]*(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS value FROM l WHERE no < coalesce(stop, 1000000)""")
def q144_tag_block_head(spark, sf):
    """Every line of every chunk's tag block."""
    rows = chunks(spark, sf).filter(F.col("text").rlike(r"^@[a-zA-Z][\w.-]*:")).select("chunk_id", T.tag_block(F.col("text")).alias("block")).distinct()
    return rows.select("chunk_id", F.explode("block").alias("b")).select("chunk_id", "b.name", "b.value").distinct()
