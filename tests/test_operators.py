"""Operators on small tables: search, vectors, tags, graph, recall, schedule, events and streams."""

import random
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorefield.operators import events as V
from lorefield.operators import graph as H
from lorefield.operators import recall as K
from lorefield.operators import schedule as P
from lorefield.operators import search as S
from lorefield.operators import stats, tags, vector_search
from lorefield.streaming import pubsub


def docs(spark, texts):
    return spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "chunk_id long, path string, text string")


def test_search_modes(spark):
    d = docs(spark, ["amber cedar maple", "amber cedar birch", "olive lemon birch", None, ""])
    score = lambda s: {r["chunk_id"]: r["score"] for r in S.by_strategy(d, "amber cedar", s, share=1.0).collect()}
    assert score("coverage") == {0: 1.0, 1: 1.0}
    assert score("density") == {0: 0.666667, 1: 0.666667}
    assert set(score("bm25")) == {0, 1}
    assert score("overlap")[0] == 9.0
    assert [r["strategy"] for r in S.escalating(d, "cedar lemon", 5).collect()] == ["density"] * 3
    assert S.multi(d, "amber cedar", 1).first()["chunk_id"] == 0
    assert S.by_strategy(d, "", "density").count() == 0


def test_repeated_rows_and_ties(spark):
    d = docs(spark, ["same text", "same text"])
    d = d.unionByName(d)
    got = S.ranked(S.by_strategy(d, "same", "density"), 10).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(0, 0.5), (1, 0.5)]


def test_overlapping_grams_count(spark):
    d = docs(spark, ["aaaa"])
    assert d.select(S._occurrences(F.col("text"), "aaa")).first()[0] == 2
    assert d.select(S._occurrences(F.col("text"), "abc")).first()[0] == 0


def test_min_span_matches_brute_force(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("a b c d e".split()) for _ in range(r.randrange(0, 14))) for _ in range(40)]

    def brute(t):
        w = t.split()
        best = [j - i + 1 for i in range(len(w)) for j in range(i, len(w)) if {"a", "b", "c"} <= set(w[i : j + 1])]
        return min(best, default=None)

    got = [x["s"] for x in docs(spark, texts).select("chunk_id", S.min_span(F.col("text"), ["a", "b", "c"]).alias("s")).orderBy("chunk_id").collect()]
    assert got == [brute(t) for t in texts]


def test_hybrid_merges(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 0.5), (3, 0.1)], "chunk_id long, score double")
    assert {r["chunk_id"]: r["score"] for r in S.merge_hybrid(a, b).collect()} == {1: 0.5, 2: 0.75, 3: 0.1}
    assert {r["chunk_id"]: r["score"] for r in S.intersect_hybrid(a, b).collect()} == {2: 0.75}


def vec_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, vec array<float>")


def test_vector_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL", 17)
    monkeypatch.setattr(vector_search, "AT_ONCE", 60)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5)).astype("f4")
    rows = [(i, f"g{i % 3}", [float(x) for x in m[i]]) for i in range(60)]
    t = vec_rows(spark, rows + [(60, "g0", [0.0] * 5), (61, "g0", None), (62, "g0", [1.0, 2.0])]).repartition(3)
    q = vec_rows(spark, rows[:6]).withColumnRenamed("id", "qid")
    got = {(r["grp"], r["id"]): r["score"] for r in vector_search.top_k(t, q, 4).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for g in range(3):
        best = (n[[i for i in range(6) if i % 3 == g]].astype("f8") @ n.T.astype("f8")).max(0)
        for i in np.argsort(-best)[:4]:
            want[f"g{g}", int(i)] = best[i]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_best_pairs(spark):
    d = vec_rows(spark, [(1, "a", [1.0, 0.0]), (2, "a", [0.6, 0.8]), (3, "b", [0.0, 1.0]), (4, "b", [0.6, 0.8])])
    got = {(r["grp"], r["other"]): (r["score"], r["src"], r["dst"]) for r in vector_search.best_pairs(d, d).collect()}
    assert got["a", "b"] == (1.0, 2, 4) and got["b", "a"] == (1.0, 4, 2)


def contributions(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, tag string, value string, tvid long, n int, origin string")


def test_tag_totals_by_source(spark):
    t = contributions(spark, [(1, "a", "x", 1, 1, "inline"), (1, "a", "y", 2, 1, "inline"), (1, "a", "x", 1, 1, "ext"), (2, "a", "x", 1, 1, "tmp"), (None, "a", "x", 1, 1, "tmp"), (3, None, "x", 1, 1, "inline")])
    assert {r["tag"]: r["n"] for r in tags.totals(t).collect()} == {"a": 3}
    assert {r["tag"]: r["n"] for r in tags.counts_for(t, ["a", "zz"]).collect()} == {"a": 3, "zz": 0}
    assert {r["value"]: r["n"] for r in tags.values(t, "a", "x").collect()} == {"x": 3}
    assert tags.totals(t.limit(0)).count() == 0


def test_size_statistics(spark):
    sizes = list(range(1, 102)) + [5, 5]
    d = spark.createDataFrame([("s", x) for x in sizes], "strategy string, size long")
    r = {x["strategy"]: x for x in stats.size_statistics(d, "strategy", "size", (0.5, 0.9)).collect()}
    ordered = sorted(sizes)
    assert r["all"]["p50"] == ordered[int(0.5 * 102)] and r["s"]["p90"] == ordered[int(0.9 * 102)]
    assert r["s"]["mean"] == sum(sizes) // len(sizes)


@pytest.mark.parametrize(
    "value, want",
    [
        ("~/lists/tools.md @shelf: upper", ("path", "~/lists/tools.md", None, "", "", [("shelf", "upper")])),
        ("item-7 @shelf: upper @wood: oak", ("path", "item-7", None, "", "", [("shelf", "upper"), ("wood", "oak")])),
        ('a.md[2]:"x @y: z" @t: v', ("path", "a.md", 2, "string", "x @y: z", [("t", "v")])),
        ("%id^ @t: v", ("uuid", "id", 1, "", "", [("t", "v")])),
        ("a.md:/re.*x/ @t: v", ("path", "a.md", None, "regex", "re.*x", [("t", "v")])),
        ("a.md:3-5 @t:", ("path", "a.md", None, "range", "3-5", [("t", "")])),
        ('2026-01-02 accepted insight: "why @x: y" a.md @t: v', ("path", "a.md", None, "", "", [("t", "v")])),
        ("a.md", None),
        ("@t: v", None),
        (None, None),
    ],
)
def test_parse_ext(spark, value, want):
    e = spark.createDataFrame([(value,)], "v string").select(H.parse_ext(F.col("v")).alias("e")).first()["e"]
    assert (e and (e["kind"], e["base"], e["nth"], e["anchor_kind"], e["anchor"], [(t["tag"], t["value"]) for t in e["tags"]])) == want


def test_routes_and_links(spark):
    ch = spark.createDataFrame([(1, "src.md", "1-1", "s"), (2, "a.md", "1-2", "first"), (3, "a.md", "3-4", "second part"), (4, "src.md", "2-2", "own")], "chunk_id long, path string, chunk_range string, text string")
    t = spark.createDataFrame(
        [(1, "ext", "a.md @k: v"), (1, "ext", 'a.md:"second" @k: w'), (1, "ext", "src.md @k: own"), (1, "ext", "%u1 @k: id"), (3, "id", "u1"), (1, "ext", "a.md:3-4 @k: r"), (1, "ext", "a.md:/^sec/ @k: x"), (1, "link", "u1"), (1, "link", "a.md"), (1, "link", "none")],
        "chunk_id long, tag string, value string",
    )
    got = {(r["source_chunk"], r["target_chunk"], r["tag"], r["value"]) for r in H.routes(t, ch).collect()}
    assert got == {(1, 2, "k", "v"), (1, 3, "k", "w"), (1, 3, "k", "id"), (1, 3, "k", "r"), (1, 3, "k", "x")}
    odd = t.unionByName(spark.createDataFrame([(1, "ext", "a.md:/[open/ @k: none")], t.schema))  # no expression: matches nothing
    assert H.routes(odd, ch).count() == len(got)
    links = {r["value"]: (r["target_chunk"], r["path"]) for r in H.resolve_links(t, ch).collect()}
    assert links == {"u1": (3, "a.md"), "a.md": (2, "a.md"), "none": (None, None)}


def test_allocation(spark):
    rows = [{"request": 1, "key": i, "source": "main" if i % 2 else "conversation", "file_id": i % 4, "meaning": (i * 7 % 10) / 10, "tags": (i * 3 % 10) / 10} for i in range(30)]
    got = K.allocate(pd.DataFrame(rows), 3, 12)
    assert len(got) == 12 and got["key"].is_unique
    assert (got["score"].diff().dropna() <= 0).all()
    of = {r["key"]: r for r in rows}
    per = got.assign(f=[of[k]["file_id"] for k in got["key"]]).groupby(["cell", "f"]).size()
    assert per.max() <= 2
    out = K.allocate_per_request(spark.createDataFrame(pd.DataFrame(rows))).toPandas()
    assert sorted(out["key"]) == sorted(got["key"])
    assert len(K.allocate(pd.DataFrame(rows)[:0])) == 0


def test_exclusion_and_cool_down(spark):
    c = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "chunk_id long, score double")
    t = contributions(spark, [(1, "a", "x", 1, 1, "inline"), (2, "a", "x", 1, 1, "inline"), (2, "b", "y", 1, 1, "inline")])
    d = spark.createDataFrame([("a", None)], "tag string, value string")
    assert {r["chunk_id"] for r in K.exclude_discussed(c, t, d).collect()} == {2, 3}
    assert {r["chunk_id"] for r in K.exclude_discussed(c, t, d, keep_tagless=False).collect()} == {2}
    s = spark.createDataFrame([(1, datetime(2026, 1, 1, 12)), (2, datetime(2026, 1, 1, 1))], "chunk_id long, ts timestamp")
    assert {r["chunk_id"] for r in K.cool_down(c, s, datetime(2026, 1, 1, 12, 30), 3600).collect()} == {2, 3}


def test_schedule(spark):
    t = spark.createDataFrame([(1, "due", "2026-03-05 x"), (1, "ack", "..2026-03-05"), (2, "due", "2026-03-06"), (3, "due", "soon"), (4, "reminder", "every monday at 10:00"), (4, "reminder", "every monday at 10:00")], "chunk_id long, tag string, value string")
    due = P.one_shot(t, "due", "2026-03-01", "2026-03-31")
    assert {(r["chunk_id"], r["day"]) for r in due.collect()} == {(1, date(2026, 3, 5)), (2, date(2026, 3, 6))}
    assert [r["chunk_id"] for r in P.acknowledged(due, P.acks_of(t)).collect()] == [2]
    got = [r["at"] for r in P.recurring(t, "reminder", datetime(2026, 3, 1), datetime(2026, 3, 10)).orderBy("at").collect()]
    assert got == [datetime(2026, 3, 2, 10), datetime(2026, 3, 9, 10)]
    e = due.select("chunk_id", "day")
    assert P.with_exceptions(e, e.filter("chunk_id = 1"), e.filter("chunk_id = 2")).count() == 1


EVENTS = "event_id long, tag string, value string, path string, ts timestamp, session string"


def event_rows():
    at = lambda i: datetime(2026, 1, 1, 0, i)
    return [(1, "x", "1", "p", at(1), "s"), (2, "x", "2", "p", at(2), "s"), (3, "y", "a", "p", at(3), "s"), (4, "x", "3", "p", at(4), "s"), (5, "x", "1", "q", at(5), "s"), (5, "x", "1", "q", at(5), "s"), (6, None, "1", "q", at(6), None)]


def test_compress_and_match(spark):
    e = V.clean_events(spark.createDataFrame(event_rows(), EVENTS))
    got = [(r["path"], r["tag"], r["value"]) for r in V.compress(e).orderBy("first_seen").collect()]
    assert got == [("p", "x", "3"), ("p", "y", "a"), ("q", "x", "1")]
    subs = [V.Subscription("a", "x=1"), V.Subscription("s", "x"), V.Subscription("b", "~^x|y$", ("p",))]
    hits = {(r["subscriber"], r["event_id"]) for r in V.match(e, subs).collect()}
    assert hits == {("a", 1), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 4)}
    assert V.notify(V.match(e, subs)).filter("subscriber = 'a'").first()["event_id"] == 1


def test_transitions(spark):
    e = V.clean_events(spark.createDataFrame(event_rows(), EVENTS))
    got = [(r["event_id"], r["change"]) for r in V.transitions(e, F.col("value").isin("1", "2")).orderBy("event_id").collect()]
    assert got == [(1, "enter"), (2, "stay"), (3, "leave"), (5, "enter")]


def test_streams_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = event_rows()
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: pubsub.event_stream(spark, folder + "/*", 1)
    hits = pubsub.run_to_end(pubsub.published(stream(), [V.Subscription("a", "x=1")]), "t1")
    assert sorted(r["event_id"] for r in hits.collect()) == [1, 5]
    pairs = pubsub.run_to_end(pubsub.new_pairs(stream()), "t2")
    assert pairs.count() == 5
    state = str(tmp_path / "state")
    # a state of its own for every batch, as after a restart: what is known is in the tables
    again = lambda batch, number: pubsub.MembershipState(spark, F.col("value").isin("1", "2"), state)(batch, number)
    moved = pubsub.run_to_end(stream(), "t3", again)
    got = [(r["event_id"], r["change"]) for r in moved.orderBy("event_id").collect()]
    assert got == [(1, "enter"), (2, "stay"), (3, "leave"), (5, "enter")]


def test_watchdog(spark):
    e = spark.createDataFrame([("remindr", "x"), ("when", "2026-01-01"), ("reminder", "every day")], "tag string, value string")
    got = {(r["kind"], r["tag"]) for r in V.watchdog(e, ["reminder"]).collect()}
    assert got == {("possible-typo", "remindr"), ("orphan-schedule", "when")}
