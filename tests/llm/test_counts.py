"""Near-duplicates, pair counts and term frequencies against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefield.llm import cooccur, near_dup, queries, term_freq
from lorefield.llm.cleaning import clean_tag, clean_value

WORD = re.compile(r"[^\W_]+")


def triples(text):
    w = WORD.findall(text.lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def noisy_copies(r, base, n):
    words = [f"w{r.randrange(400)}" for _ in range(60)]
    out = []
    for _ in range(n):
        v = list(words)
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(v))
            way = r.randrange(3)
            if way == 0:
                v[at] = f"n{r.randrange(999)}"
            elif way == 1:
                del v[at]
            else:
                v.insert(at, "extra")
        if r.random() < 0.3:
            cut = r.randrange(10, len(v) - 10)
            v = v[cut:] + v[:cut]
        out.append(" ".join(v))
    return out


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(11)
    texts = [t for k in range(12) for t in noisy_copies(r, k, 5)]
    texts += [texts[0], texts[0].upper(), "short text", "", None, "a b c " * 30, "a b c " * 31]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, texts[0])], "chunk_id long, text string").withColumn("id", F.lit(1)).withColumn("tab", F.lit(2))
    tables = {"chunk": (df, "chunk_id", "text"), "entry": (df.limit(0), "chunk_id", "text")}
    links, members, names = near_dup.near_duplicates(tables)
    got = {tuple(x) for x in near_dup.expand(links, members, near_dup.prepare(tables), names).collect()}
    sets = {i: s for i, t in rows if t and (s := triples(t))}
    want = {("chunk", a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == want
    few = near_dup.classes(links, members, names)
    assert few.filter("copies_a > 1 or copies_b > 1").count() > 0
    # all members of a class share one row per partner class
    assert few.count() == few.select("rep_a", "rep_b").distinct().count()


def test_near_duplicates_of_empty_tables(spark):
    df = spark.createDataFrame([], "chunk_id long, text string")
    tables = {"chunk": (df, "chunk_id", "text")}
    links, members, names = near_dup.near_duplicates(tables)
    assert near_dup.expand(links, members, near_dup.prepare(tables), names).count() == 0


def test_a_large_class_is_paired_in_portions(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PORTION", 4)
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(i, text) for i in range(23)] + [(30, text + " more")], "chunk_id long, text string")
    tables = {"chunk": (df, "chunk_id", "text")}
    links, members, names = near_dup.near_duplicates(tables)
    got = [(r["id_a"], r["id_b"]) for r in near_dup.expand(links, members, near_dup.prepare(tables), names).collect()]
    ids = [*range(23), 30]
    assert sorted(got) == [(a, b) for a in ids for b in ids if a < b]
    assert {r["edits"] for r in links.collect()} == {1}


def test_a_distance_proves_no_more_than_the_shingles_hold():
    r = random.Random(9)
    for _ in range(400):
        a = [r.randrange(30) for _ in range(r.randrange(20, 60))]
        b = list(a)
        for _ in range(r.randrange(0, 9)):
            way, at = r.randrange(3), r.randrange(len(b))
            b[at : at + (way != 1)] = [] if way == 0 else [r.randrange(30, 40)]
        x, y = (set(zip(w, w[1:], w[2:])) for w in (a, b))
        assert near_dup.proven(np.array([d := near_dup.farthest(np.array([len(x)]), np.array([len(y)]), 0.6)[0]]), np.array([len(x)]), np.array([len(y)]), 0.6)[0] or d < 0
        if near_dup.proven(np.array([edit_distance(a, b)]), np.array([len(x)]), np.array([len(y)]), 0.6)[0]:
            assert len(x & y) >= 0.6 * len(x | y)


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_banded_alignment_is_exact_within_its_band():
    r = random.Random(4)
    pairs = []
    for _ in range(80):
        a = [r.randrange(6) for _ in range(r.randrange(0, 25))]
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            if b and r.random() < 0.5:
                del b[r.randrange(len(b))]
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(6))
        pairs.append((a, b))
    got = near_dup.alignment_distance([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    want = [edit_distance(a, b) for a, b in pairs]
    assert got.tolist() == want
    most = np.array([r.randrange(0, 6) for _ in pairs])
    near = near_dup.alignment_distance([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs], most=most)
    assert near.tolist() == [d if d <= m else near_dup.FAR for d, m in zip(want, most.tolist())]


def brute_pairs(rows, rule):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i:
            baskets[b].add(i)
    n = Counter(i for s in baskets.values() for i in s)
    pair = Counter((a, b) for s in baskets.values() for a in s for b in s if a < b)
    total = len(baskets)
    return {(a, b): c for (a, b), c in pair.items() if c >= rule.least and c * rule.share >= total and c * total >= rule.lift * n[a] * n[b]}


@pytest.mark.parametrize("limit", [2, 32])
def test_pair_table_and_updates(spark, monkeypatch, limit):
    monkeypatch.setattr(cooccur, "LEAST_LIMIT", limit)
    r = random.Random(2)
    rule = cooccur.Rule(least=3, share=50, lift=2)

    def basket(b):
        group = b % 7
        items = [f"g{group}-{r.randrange(3)}" for _ in range(3)] + [f"x{r.randrange(60)}" for _ in range(r.randrange(3))]
        return [(b, i) for i in items]

    first = [x for b in range(150) for x in basket(b)] + [(1000, f"g{g}-{k}") for g in range(7) for k in range(3)] + [(1001, f"x{k}") for k in range(60)]
    first += first[:20] + [(None, "a"), (5, None), (6, "")]
    mk = lambda rows: spark.createDataFrame(rows, "basket long, item string")
    table = cooccur.PairTable(spark, rule=rule).update(mk(first))
    found = lambda t: {(x["item_a"], x["item_b"]): x["n_ab"] for x in t.associated().collect()}
    assert found(table) == brute_pairs(first, rule)
    # some baskets change, some vanish, some are new; items gain and lose their place
    second = [x for b in range(100, 260) for x in basket(b)] + [(b, f"new-{k}") for b in range(300, 312) for k in range(3)] + [(1001, None), (3, "")]
    named = {b for b, _ in second}
    later = [(b, i) for b, i in first if b not in named] + [(b, i) for b, i in second if i]
    table = table.update(mk(second))
    assert found(table) == brute_pairs(later, rule)
    # the detour back gives the first state again, by negative deltas
    back = [(b, i) for b, i in first if b in named] + [(b, "") for b in named]
    assert found(table.update(mk(back))) == brute_pairs(first, rule)


def test_an_update_writes_touched_buckets_only(spark):
    """One per cent of the baskets change: every other bucket keeps the files it had."""
    rule = cooccur.Rule(least=2, share=1000, lift=2)
    first = [(b, f"g{b % 50}-{k}") for b in range(400) for k in range(3)]
    second = [(b, x) for b in (7, 57, 107, 157) for x in ("g7-0", "g7-1", "g8-2")]
    mk = lambda rows: spark.createDataFrame(rows, "basket long, item string")
    before = cooccur.PairTable(spark, rule=rule).update(mk(first))
    after = before.update(mk(second))
    number = lambda key, value: spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in value]), F.lit(cooccur.BUCKETS))).first()[0]
    want = {
        "baskets": {number("basket", [b]) for b, _ in second},
        "pairs": {number("pair", p) for p in (("g7-0", "g7-2"), ("g7-1", "g7-2"), ("g7-0", "g8-2"), ("g7-1", "g8-2"))},
    }
    for name, buckets in want.items():
        assert {k for k, v in after.files[name].items() if v == after.version} <= buckets
        assert {k: v for k, v in after.files[name].items() if k not in buckets} == {k: v for k, v in before.files[name].items() if k not in buckets}
    rewritten = {k for k, v in after.files["scores"].items() if v == after.version}
    assert 0 < len(rewritten) < len(before.files["scores"])
    later = [(b, i) for b, i in first if b not in (7, 57, 107, 157)] + second
    assert {(x["item_a"], x["item_b"]): x["n_ab"] for x in after.associated().collect()} == brute_pairs(later, rule)


def test_pair_table_of_nothing(spark):
    table = cooccur.PairTable(spark).update(spark.createDataFrame([], "basket long, item string"))
    assert table.associated().count() == 0


def test_term_counts(spark):
    rows = [(1, "@Status:", " x ", 1), (1, "@Status:", " x ", 1), (1, "status", "y", 2), (2, "status ", None, None), (3, None, "x", 1), (4, "  ", "", 1), (None, "status", "x", 1), (5, "rare", "z", 3)]
    df = spark.createDataFrame(rows, "chunk_id long, tag string, value string, n int").withColumn("term", F.lit("clash")).withColumn("field", F.lit("clash"))
    fields = [term_freq.TermField("tag", df, "chunk_id", clean_tag(F.col("tag")), ("tag", "value"), (1, 5), F.col("n")), term_freq.TermField("value", df, "chunk_id", clean_value(F.col("value")), ("tag", "value"), (1, 10))]
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in term_freq.term_counts(fields, 2).collect()}
    assert got["tag", "status"] == (4, 2, "common")
    assert got["tag", "rare"] == (3, 1, "rare")
    assert got["value", "x"] == (2, 2, "common") and ("tag", "") not in got
    empty = [term_freq.TermField("tag", df.limit(0), "chunk_id", clean_tag(F.col("tag")), ("tag",), (1, 5))]
    assert term_freq.term_counts(empty).count() == 0


def test_every_query_runs(spark, sf):
    for name, f in queries.queries().items():
        df = f(spark, sf)
        assert df.columns and df.count() >= 0, name


def test_columns_of_found(spark, sf):
    want = {
        "p1_found": "struct<src:string,rec_id:bigint,kind:string,start_pos:bigint>",
        "p2_found": "struct<item_a:string,item_b:string>",
        "p3_found": "struct<src:string,id_a:bigint,id_b:bigint>",
        "p4_found": "struct<src:string,rec_id:bigint,line_from:bigint,line_to:bigint>",
        "p5_found": "struct<field:string,term:string,mark:string>",
        "p6_ids": "struct<doc_id:bigint,ids:array<int>>",
        "p7_found": "struct<doc_id:bigint,item_id:bigint>",
        "p8_found": "struct<doc_id:bigint,kind:string>",
    }
    for name, schema in want.items():
        assert queries.queries()[name](spark, sf).schema.simpleString() == schema
