"""Filter stacks, search specifications and the corpus object."""

import pytest

from lorefield.engine import Corpus
from lorefield.plans.more_queries import hashed_embedding
from lorefield.plans.spec import FilterRow, SearchSpec, apply_filters, parse_stack


def test_parse_stack():
    rows = parse_stack("stale recall -tag status=open -without -files *.md -filter-k 5 -about note -with word".split())
    assert rows == [FilterRow("contains", "stale recall"), FilterRow("tag", "status=open"), FilterRow("files", "*.md", True), FilterRow("about", "note", True, 5), FilterRow("contains", "word")]
    for bad in (["-tag"], ["-nope", "x"], ["-regex", "(?=x)"], ["-tag", "=x"]):
        with pytest.raises(ValueError):
            parse_stack(bad)


@pytest.mark.parametrize("kw", [{"like_file": "a", "contains": "b"}, {"multi": True, "score": "bm25"}, {"fuzzy": True, "multi": True}, {"score": "x"}, {"k": 0}])
def test_incompatible_options(kw):
    with pytest.raises(ValueError):
        SearchSpec(**kw)


def test_apply_filters(spark):
    ch = spark.createDataFrame([(1, "a.md", "apple"), (2, "a.md", "pear"), (3, "b.py", "apple pie"), (4, None, None)], "chunk_id long, path string, text string")
    t = spark.createDataFrame([(2, "status", "open"), (None, "status", "open")], "chunk_id long, tag string, value string")
    ids = lambda rows, about=None: sorted(r["chunk_id"] for r in apply_filters(ch, rows, t, about).collect())
    assert ids([FilterRow("contains", "APPLE")]) == [1, 3, 4]
    assert ids([FilterRow("contains", "apple", True)]) == [2, 4]
    assert ids([FilterRow("tag", "status")]) == [2]
    assert ids([FilterRow("tag", "status", True)]) == [1, 3, 4]
    assert ids([FilterRow("file-tag", "status")]) == [1, 2]
    assert ids([FilterRow("file-tag", "status", True)]) == [3, 4]
    assert ids([FilterRow("files", "*.md")]) == [1, 2]
    assert ids([FilterRow("about", "x")], {"x": ch.limit(0)}) == []
    assert ids([FilterRow("about", "x", True)], {"x": ch.filter("chunk_id = 1")}) == [2, 3, 4]
    assert ids([]) == [1, 2, 3, 4]


def test_corpus(spark, sf):
    c = Corpus(spark, sf)
    assert c.search(SearchSpec(contains="recall", k=5)).count() <= 5
    assert c.search(SearchSpec(about="stale recall", multi=True, k=3)).count() == 3
    assert c.search(SearchSpec(regex=("[0-9]{3}",), k=4)).count() == 4
    assert c.tag_totals().count() > 0 and c.chunk_sizes().count() > 0
    assert c.recall(["stale recall"], 4).count() <= 4


def test_hashed_embedding(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    got = {r["id"]: r["vec"] for r in hashed_embedding(d, "id", "t", 8).collect()}
    assert len(got[1]) == 8 and sum(map(abs, got[1])) in (1.0, 3.0) and got[2] == [0.0] * 8 and 3 not in got
