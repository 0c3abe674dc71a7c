"""Queries and operators that must not cut their input short."""

import re

from lorefield.operators import recall as K
from lorefield.plans import queries


def test_recall_passes_cut_per_input(spark):
    rows = [(i, "alpha beta gamma") for i in range(5)] + [(i, "delta epsilon zeta and more") for i in range(5, 8)]
    got = K.trigram_pass(spark.createDataFrame(rows, "chunk_id long, text string"), ["alpha beta gamma", "delta epsilon zeta"], 2).collect()
    assert sorted(r["chunk_id"] for r in got) == [0, 1, 5, 6]
    assert {r["score"] for r in got if r["chunk_id"] < 5} == {1.0}


def test_tag_pass_takes_every_chunk_of_the_best_values(spark):
    rows = [(i, "topic", "slow rivers") for i in range(120)] + [(i, "topic", f"slow {i}") for i in range(200, 203)] + [(300, "status", "quick"), (301, "status", "quick")]
    tags = spark.createDataFrame(rows, "chunk_id long, tag string, value string")
    got = {r["chunk_id"]: r["score"] for r in K.tag_pass(tags, ["slow rivers", "quick"], 1).collect()}
    assert got == {**{i: 1.0 for i in range(120)}, 300: 1.0, 301: 1.0}
    # a discussed value takes no place among the best
    discussed = spark.createDataFrame([("topic", "slow rivers"), ("status", None)], "tag string, value string")
    assert {r["chunk_id"]: r["score"] for r in K.tag_pass(tags, ["slow rivers", "quick"], 1, discussed).collect()} == {200: 0.25}


TAG = re.compile(r"@([a-zA-Z][\w.-]*):[ \t]*([^\n]*)")


def _stripped(text):
    if text is None:
        return None
    out, fenced = [], False
    for line in text.split("\n"):
        fence = line.lstrip(" ").startswith("```")
        inside, fenced = fenced or fence, fenced != fence
        m = TAG.search(line)
        if m:
            pre = line[: m.start()]
            mention = (pre and pre[-1] not in " \t") or sum(c in '`"' for c in pre) % 2 or inside or line[0] == "\t" or line.startswith("    ")
            if not mention:
                if pre.strip():
                    out.append(pre)
                continue
        out.append(line)
    return "\n".join(out)


def _texts(spark, sf):
    return {(r["chunk_id"], r["text"]) for r in spark.read.parquet(f"{sf}/chunk_results.parquet").select("chunk_id", "text").collect()}


def test_strip_tags_takes_every_chunk(spark, sf, tmp_path):
    rows = [(1, "```\n@a: kept\n```\n@b: gone\nend"), (2, "due @c: soon\nsay `@d: kept`"), (3, None)]
    spark.createDataFrame(rows, "chunk_id long, text string").write.parquet(f"{tmp_path}/chunk_results.parquet")
    for at in (str(tmp_path), sf):
        texts = _texts(spark, at)
        got = [tuple(r) for r in queries.queries()["q142_strip_tags"](spark, at).select("chunk_id", "text").collect()]
        assert len(got) == len(texts) and set(got) == {(i, _stripped(t)) for i, t in texts}


def test_every_line_of_a_tag_block_and_every_reference(spark, tmp_path):
    rows = [(1, "@to: a\n@Status:  open \n\n@late: 3:16"), (1, "@to: a\n@Status:  open \n\n@late: 3:16"), (2, "see 3:16 and 12:1, then 3:16"), (3, None)]
    spark.createDataFrame(rows, "chunk_id long, text string").write.parquet(f"{tmp_path}/chunk_results.parquet")
    q = queries.queries()
    got = q["q144_tag_block_head"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "status", "open"), (1, "to", "a")]
    got = q["q166_chapter_verse"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("12:1", 12, 1), ("3:16", 3, 16)]


def test_every_request_is_allocated(spark, sf):
    e = spark.read.parquet(f"{sf}/search_entries.parquet").filter("query_id is not null and entry_id is not null").toPandas()
    e = e.assign(key=e.entry_id, source=["conversation" if (p or "").endswith(".jsonl") else "main" for p in e.path], file_id=e.file_id.fillna(-1), meaning=e.vec_score.fillna(0.0), tags=e.fts_score.fillna(0.0))
    e = e[["query_id", "key", "source", "file_id", "meaning", "tags"]].drop_duplicates()
    want = {(q, r.key, r.cell, r.score) for q, g in e.groupby("query_id") for r in K.allocate(g).itertuples()}
    assert {tuple(r) for r in queries.queries()["q123_allocate_2x2"](spark, sf).collect()} == want


def test_locators_try_whole_lines(spark):
    from lorefield.operators.locator import suggest

    line = "one two three four five six seven eight nine"
    ch = spark.createDataFrame([(1, "p", "1-1", f"{line} ten"), (2, "p", "2-2", f"{line} eleven")], "chunk_id long, path string, chunk_range string, text string")
    assert {r["chunk_id"]: r["anchor"] for r in suggest(ch, ch).collect()} == {1: f"{line} ten", 2: f"{line} eleven"}


def test_connections_cap_their_evidence(spark):
    hits = spark.createDataFrame([(0, i, 1.0 - i / 100, i + 1) for i in range(50)], "input int, chunk_id long, score double, rank int")
    none, tags = hits.limit(0), spark.createDataFrame([(i, "a") for i in range(50)] + [(3, "b"), (None, "b"), (4, None)], "chunk_id long, tag string")
    defs = spark.createDataFrame([(0, "b", 0.25), (1, "c", 0.5)], "input int, tag string, score double")
    got = {r["tag"]: (r["vector_ed"], r["trigram_ed"], r["vector_ec"], r["trigram_ec"], r["chunks"]) for r in K.connections(defs, defs.limit(0), hits, none, tags, 5, evidence=3).collect()}
    assert got == {"a": (0.0, 0.0, 1.0, 0.0, "0,1,2"), "b": (0.25, 0.0, 0.97, 0.0, "3"), "c": (0.5, 0.0, 0.0, 0.0, "")}
    last = K.connections(defs, defs.limit(0), none, hits, tags, 1, evidence=60, admitted=40).first()
    assert last["tag"] == "a" and last["chunks"].count(",") == 39


def test_recall_is_the_allocation_of_its_candidates(spark, sf):
    q = queries.queries()
    c = q["q188_candidates"](spark, sf).toPandas()
    files = spark.read.parquet(f"{sf}/files.parquet").groupBy("path").min("file_id").toPandas().set_index("path")["min(file_id)"]
    c = c.assign(key=c.chunk_id, source=["conversation" if p.endswith(".jsonl") else "main" for p in c.path], file_id=[files.get(p, -1) for p in c.path])
    want = {(r.key, r.cell, r.score) for r in K.allocate(c, 3, 20).itertuples()}
    assert {tuple(r) for r in q["q188_recall"](spark, sf).collect()} == want and len(want) > 4


def test_sweeps_equal_a_sweep_from_scratch(spark):
    import random

    from lorefield.operators.hot import HotTable

    r = random.Random(3)
    vec = lambda: [r.gauss(0, 1) for _ in range(6)]
    chunks, defs = {i: (vec(), 1) for i in range(80)}, {(t, f): (vec(), 1) for t in "abc" for f in (1, 2)}
    frames = lambda: (
        spark.createDataFrame([(i, v, s) for i, (v, s) in chunks.items()], "id long, vec array<float>, serial long"),
        spark.createDataFrame([(t, f, v, s) for (t, f), (v, s) in defs.items()], "tag string, file_id int, vec array<float>, serial long"),
    )
    rows = lambda t: sorted((x["tag"], x["chunk_id"], round(x["score"], 6)) for x in t.buckets().collect())
    table = HotTable(spark, k=5).sweep(*frames())
    best = [i for t, i, _ in rows(table) if t == "a"][:3]
    for i in [*best, 90, 91]:  # stored chunks lose their score, new ones come
        chunks[i] = vec(), 2
    defs["b", 1] = vec(), 2
    del chunks[rows(table)[-1][1]]
    after = table.sweep(*frames())
    assert rows(after) == rows(HotTable(spark, k=5).sweep(*frames())) and after.bookmark == 2
    late = spark.createDataFrame([(i, 3 if i == 90 else 1) for i in chunks], "id long, serial long")
    assert {x["tag"] for x in after.fresh(late, frames()[1]).collect()} <= set("abc") and 90 not in {x["chunk_id"] for x in after.fresh(late, frames()[1]).collect()}
