"""Events, subscriptions, schedules and their streaming forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import text as T
from lorefield.operators import events as V
from lorefield.operators import schedule as P
from lorefield.plans.common import Registry
from lorefield.session import read_table
from lorefield.streaming import pubsub as B

R = Registry()
#: DuckDB text that strips white space and no-break spaces.
STRIP = "regexp_replace({c}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"
V_STRIP, T_STRIP = STRIP.format(c="value"), STRIP.format(c="tag")
EV = f"(SELECT event_id, lower({STRIP.format(c='tag')}) AS tag, coalesce(value, '') AS value, path, ts, session FROM (SELECT DISTINCT event_id, tag, value, path, ts, session FROM tag_events) WHERE event_id IS NOT NULL AND tag IS NOT NULL)"
SUBS = [V.Subscription("s0001", "status=blocked"), V.Subscription("s0002", "project"), V.Subscription("s0003", ":deci", (), ("tmp://**",)), V.Subscription("s0004", "priority~^[1-3]$", ("*.md",))]
MATCH = f"""(SELECT 's0001' AS subscriber, 'status=blocked' AS subscription, * FROM {EV} WHERE tag = 'status' AND value = 'blocked' AND session IS DISTINCT FROM 's0001'
    UNION ALL SELECT 's0002', 'project', * FROM {EV} WHERE tag = 'project' AND session IS DISTINCT FROM 's0002'
    UNION ALL SELECT 's0003', ':deci', * FROM {EV} WHERE contains(tag, 'deci') AND NOT coalesce(regexp_matches(path, '^tmp://'), true) AND session IS DISTINCT FROM 's0003'
    UNION ALL SELECT 's0004', 'priority~^[1-3]$', * FROM {EV} WHERE tag = 'priority' AND regexp_matches(value, '^[1-3]$') AND coalesce(regexp_matches(path, '\\.md$'), false) AND session IS DISTINCT FROM 's0004')"""


def _events(spark, sf):
    return V.clean_events(read_table(spark, sf, "tag_events"))


@R.add(f"SELECT subscriber, subscription, event_id, tag, value FROM {MATCH}")
def q208_publish_match(spark, sf):
    return V.match(_events(spark, sf), SUBS).select("subscriber", "subscription", "event_id", "tag", "value")


@R.add(f"SELECT subscriber, subscription, event_id, tag, value FROM {MATCH} WHERE ts IS NOT NULL")
def q208_publish_match_stream(spark, sf):
    """The same as a stream that is run to its end."""
    out = B.run_to_end(B.published(B.event_stream(spark, f"{sf}/tag_events.parquet"), SUBS), "published")
    return out.select("subscriber", "subscription", "event_id", "tag", "value")


@R.add(f"SELECT subscriber, tag, value, min(event_id) AS event_id FROM {MATCH} GROUP BY ALL")
def q208_notifications(spark, sf):
    return V.notify(V.match(_events(spark, sf), SUBS))


@R.add(f"SELECT subscriber, tag, value, min(event_id) AS event_id FROM {MATCH} m WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {EV} u WHERE u.tag = 'mute' AND u.value = 'true' AND u.path = m.path) GROUP BY ALL")
def q208_muted_notifications(spark, sf):
    e = _events(spark, sf)
    muted = e.filter("tag = 'mute' and value = 'true'").select("path").filter("path is not null")
    return V.notify(V.match(e.filter("path is not null"), SUBS, muted))


@R.add(f"SELECT subscriber, subscription, count(*) AS hits, greatest(count(*) - 100, 0) AS drops FROM {MATCH} GROUP BY ALL")
def q116_subscriber_stats(spark, sf):
    return V.subscriber_stats(V.match(_events(spark, sf), SUBS), 100)


@R.add(f"SELECT path, tag, arg_max(value, event_id) AS value, max(event_id) AS event_id, min(event_id) AS first_seen FROM {EV} WHERE path IS NOT NULL GROUP BY ALL")
def q115_compress_batch(spark, sf):
    return V.compress(_events(spark, sf).filter("path is not null")).select("path", "tag", "value", "event_id", "first_seen")


@R.add(f"SELECT DISTINCT path, tag, value FROM (SELECT path, lower({T_STRIP}) AS tag, coalesce(value, '') AS value FROM tag_events WHERE path IS NOT NULL AND tag IS NOT NULL)")
def q212_new_pairs_stream(spark, sf):
    return B.run_to_end(B.new_pairs(B.event_stream(spark, f"{sf}/tag_events.parquet")), "new-pairs")



def _member():
    return (F.col("tag") == "status") & F.col("value").isin("open", "in-progress")


TRANSITIONS = f"""SELECT path, event_id, change FROM (SELECT path, event_id, CASE WHEN NOT was AND is_in THEN 'enter' WHEN was AND is_in THEN 'stay' WHEN was THEN 'leave' END AS change
    FROM (SELECT path, event_id, is_in, coalesce(lag(is_in) OVER (PARTITION BY path ORDER BY ts, event_id), false) AS was FROM (SELECT *, tag = 'status' AND value IN ('open', 'in-progress') AS is_in FROM {EV} WHERE path IS NOT NULL AND ts IS NOT NULL))) WHERE change IS NOT NULL"""


@R.add(TRANSITIONS)
def q211_transitions(spark, sf):
    return V.transitions(_events(spark, sf).filter("path is not null and ts is not null"), _member())


@R.add(TRANSITIONS)
def q211_transitions_stream(spark, sf):
    stream = B.event_stream(spark, f"{sf}/tag_events.parquet")
    return B.run_to_end(stream, "transitions", B.MembershipState(spark, _member()))


@R.add(f"""SELECT 'orphan-schedule' AS kind, tag, value, CAST(NULL AS VARCHAR) AS near_tag FROM (SELECT DISTINCT tag, value FROM {EV} WHERE tag NOT IN ('status', 'reminders', 'decisions')) AS o WHERE regexp_matches(lower({V_STRIP}), '^(?:.{{4}}[-/].{{2}}[-/].{{2}}|.{{2}}[-/].{{2}}|every )')
    UNION ALL SELECT 'possible-typo' AS kind, tag, value, near_tag FROM (SELECT tag, value, near_tag, list_distinct(list_transform(range(1, length(tag) - 1), lambda i: substr(tag, CAST(i AS INTEGER), 3))) AS g, list_distinct(list_transform(range(1, length(near_tag) - 1), lambda i: substr(near_tag, CAST(i AS INTEGER), 3))) AS s
      FROM (SELECT DISTINCT tag, value FROM {EV} WHERE tag NOT IN ('status', 'reminders', 'decisions') AND length(tag) >= 3), (SELECT unnest(['status', 'reminders', 'decisions']) AS near_tag)) WHERE round(len(list_intersect(g, s)) / (len(g) + len(s) - len(list_intersect(g, s))), 6) >= 0.4""")
def q216_watchdog(spark, sf):
    return V.watchdog(_events(spark, sf), ["status", "reminders", "decisions"]).select("kind", "tag", "value", "near_tag")


@R.add("""WITH l AS (SELECT session, max(ts) AS last FROM (SELECT DISTINCT event_id, session, ts FROM tag_events WHERE event_id IS NOT NULL AND tag IS NOT NULL) WHERE session IS NOT NULL AND ts IS NOT NULL GROUP BY session)
    SELECT session, last FROM l WHERE epoch_us(date_trunc('second', (SELECT max(last) FROM l))) - epoch_us(date_trunc('second', last)) <= CAST(30000000 AS BIGINT) * 86400""")
def q215_reap(spark, sf):
    return V.reap(_events(spark, sf), 30 * 86400)


@R.add(f"SELECT date_trunc('day', ts) AS start, tag, count(*) AS n FROM (SELECT lower({T_STRIP}) AS tag, ts FROM tag_events WHERE tag IS NOT NULL AND ts IS NOT NULL) GROUP BY ALL")
def ext_windowed_counts(spark, sf):
    """Extension: events per day and tag, as a stream in update mode run to its end."""
    stream = B.windowed_counts(B.event_stream(spark, f"{sf}/tag_events.parquet", 1_000_000), "1 day", "3650 days")
    return B.run_to_end(stream, "windows", mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


TAGS = "(SELECT DISTINCT chunk_id, tag, value FROM tag_values WHERE chunk_id IS NOT NULL AND tag IS NOT NULL AND value IS NOT NULL)"


@R.add(f"""SELECT DISTINCT chunk_id, try_cast(regexp_extract({V_STRIP}, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) AS day, {V_STRIP} AS value FROM {TAGS} WHERE lower(tag) = 'due' AND try_cast(regexp_extract({V_STRIP}, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) BETWEEN DATE '2026-03-01' AND DATE '2026-09-30'""")
def q218_due_in_range(spark, sf):
    return P.one_shot(read_table(spark, sf, "tag_values"), "due", "2026-03-01", "2026-09-30")


_ACK = f"""(SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(v, '^\\.\\.\\s*\\d{{4}}-\\d\\d-\\d\\d') THEN NULL ELSE try_cast(regexp_extract(v, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) END AS a,
    CASE WHEN regexp_matches(v, '^\\.\\.\\s*\\d{{4}}-\\d\\d-\\d\\d') THEN try_cast(regexp_extract(v, '^\\.\\.\\s*(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) WHEN regexp_matches(v, '^\\d{{4}}-\\d\\d-\\d\\d\\s*\\.\\.\\s*\\d{{4}}-\\d\\d-\\d\\d') THEN try_cast(regexp_extract(v, '\\.\\.\\s*(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) ELSE try_cast(regexp_extract(v, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) END AS b
    FROM (SELECT chunk_id, regexp_replace(value, '^[\\s\\x{{00a0}}]+', '') AS v FROM {TAGS} WHERE lower(tag) = 'ack'))"""


@R.add(f"SELECT chunk_id, a, b FROM {_ACK} WHERE b IS NOT NULL")
def q158_ack_intervals(spark, sf):
    return P.acks_of(read_table(spark, sf, "tag_values")).select("chunk_id", F.col("interval.start").alias("a"), F.col("interval.end").alias("b"))


@R.add(f"""WITH d AS (SELECT DISTINCT chunk_id, try_cast(regexp_extract({V_STRIP}, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS DATE) AS day FROM {TAGS} WHERE lower(tag) = 'due')
    SELECT chunk_id, day FROM d WHERE day BETWEEN DATE '2026-01-01' AND DATE '2026-12-31' AND NOT EXISTS (SELECT 1 FROM {_ACK} k WHERE k.b IS NOT NULL AND k.chunk_id = d.chunk_id AND (k.a IS NULL OR k.a <= d.day) AND d.day <= k.b)""")
def q219_gaps(spark, sf):
    """Due dates of a year that no acknowledgement of their chunk covers."""
    t = read_table(spark, sf, "tag_values")
    due = P.one_shot(t, "due", "2026-01-01", "2026-12-31").select("chunk_id", "day").distinct()
    return P.acknowledged(due, P.acks_of(t)).select("chunk_id", "day")


@R.add(None)
def q218_recurring_in_range(spark, sf):
    """Occurrences of the recurring reminders within two weeks; tested against brute force."""
    return P.recurring(read_table(spark, sf, "tag_values"), "reminder", datetime(2026, 3, 1), datetime(2026, 3, 14, 23, 59))


@R.add(None)
def q156_next_occurrence(spark, sf):
    """The next occurrence of every distinct reminder after the first of March."""
    specs = read_table(spark, sf, "tag_values").filter("lower(tag) = 'reminder' and value is not null").select(F.trim(F.regexp_replace("value", " ", " ")).alias("spec")).distinct()
    return specs.select("spec", D.next_occurrences("spec", F.lit("2026-03-01 00:00:00").cast("timestamp_ntz")).alias("next"))


@R.add(f"""SELECT DISTINCT chunk_id, value FROM {TAGS} WHERE regexp_matches(lower({V_STRIP}), '^(?:.{{4}}[-/].{{2}}[-/].{{2}}|.{{2}}[-/].{{2}}|every )')""")
def q157_schedulable(spark, sf):
    t = read_table(spark, sf, "tag_values").filter("chunk_id is not null and tag is not null and value is not null")
    return t.filter(D.looks_schedulable(F.col("value"))).select("chunk_id", "value").distinct()


@R.add(f"""SELECT tag, path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tag, path ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn, count(*) OVER (PARTITION BY tag, path) AS n FROM {EV}) WHERE n <= 6 OR rn <= 3""")
def q220_trim_log(spark, sf):
    return P.trim_log(_events(spark, sf), 6).select("tag", "path", "event_id")


@R.add(f"""SELECT tag, count(*) AS n, count(DISTINCT path) AS paths, max(ts) AS last_fire FROM {EV} WHERE regexp_matches(lower({V_STRIP}), '^(?:.{{4}}[-/].{{2}}[-/].{{2}}|.{{2}}[-/].{{2}}|every )') GROUP BY tag""")
def q222_schedule_summary(spark, sf):
    e = _events(spark, sf).filter(D.looks_schedulable(F.col("value")))
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.max("ts").alias("last_fire"))


@R.add(f"""SELECT session, event_id, ts FROM {EV} WHERE session IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) <= 2""")
def q132_recent_per_session(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, sf).filter("session is not null and ts is not null")
    return e.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("session", "event_id", "ts")


@R.add(f"""SELECT session, tag, value, max(ts) AS last FROM {EV} WHERE session IS NOT NULL AND ts >= TIMESTAMP '2026-06-01' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2026-06-01' GROUP BY ALL""")
def q204_discussed_within_ttl(spark, sf):
    """What a session has discussed within thirty days before a moment."""
    now, ttl = F.lit("2026-06-01").cast("timestamp_ntz"), F.lit("2026-05-02").cast("timestamp_ntz")
    e = _events(spark, sf).filter("session is not null").filter((F.col("ts") >= ttl) & (F.col("ts") <= now))
    return e.groupBy("session", "tag", "value").agg(F.max("ts").alias("last"))


@R.add(f"""WITH r AS (SELECT *, try_cast(value AS BIGINT) AS num FROM {EV} WHERE ts IS NOT NULL), m AS (SELECT tag, event_id, num, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS rn, row_number() OVER (PARTITION BY tag, num IS NULL ORDER BY ts DESC, event_id DESC) AS rv FROM r)
    SELECT tag, max(event_id) FILTER (rn = 1) AS latest, max(num) FILTER (rv = 1 AND num IS NOT NULL) AS last_number, CAST(floor(sum(num) FILTER (rn <= 20) / count(num) FILTER (rn <= 20)) AS BIGINT) AS mean20 FROM m GROUP BY tag""")
def q118_monitor_summary(spark, sf):
    """Per class (tag): the latest record, the latest number, and the mean over the last twenty records."""
    from pyspark.sql import Window

    e = _events(spark, sf).filter("ts is not null").withColumn("num", F.expr("try_cast(value as bigint)"))
    w = Window.partitionBy("tag").orderBy(F.desc("ts"), F.desc("event_id"))
    e = e.withColumn("rn", F.row_number().over(w))
    order = F.struct("ts", "event_id")
    near = F.when(F.col("rn") <= 20, F.col("num"))
    return e.groupBy("tag").agg(
        F.max_by("event_id", order).alias("latest"),
        F.max_by("num", F.when(F.col("num").isNotNull(), order)).alias("last_number"),
        F.floor(F.sum(near) / F.count(near)).alias("mean20"),
    )
