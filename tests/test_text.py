"""Text functions against plain Python twins, and the documented edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefield.functions import text as T


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def column(spark, values, expr):
    out = rows(spark, values).select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcé漢😀 \n", max_size=12), min_size=1, max_size=12))
def test_gram_codes_count_and_jaccard(spark, values):
    assert column(spark, values, lambda t: F.size(T.gram_codes(t))) == [len(grams(v)) for v in values]
    got = column(spark, values, lambda t: T.jaccard(T.literal_codes("abcab"), T.gram_codes(t)))
    assert got == pytest.approx([jaccard("abcab", v) for v in values])


def test_null_and_empty_texts(spark):
    assert column(spark, [None, ""], lambda t: F.coalesce(F.array_size(T.gram_codes(t)), F.lit(-9))) == [-9, 0]
    assert column(spark, [None, ""], lambda t: F.size(T.extract_tags(t, F.lit(True)))) == [0, 0]
    assert column(spark, [None, ""], lambda t: T.preview(t, "x", 5)) == [None, ""]


def test_first_tag_per_line_wins(spark):
    text = "@cite: lists/paint.txt:7 @tone: a warm grey"
    got = column(spark, [text], lambda t: T.extract_tags(t, F.lit(False)))[0]
    assert [(r["tag"], r["value"]) for r in got] == [("cite", "lists/paint.txt:7 @tone: a warm grey")]
    assert column(spark, [text], T.count_tags)[0] == ["cite", "tone"]


@pytest.mark.parametrize(
    "text, tags",
    [
        ("above\n```\n@shade: within the fence\n```\n@state: dry\n", ["state"]),
        ("left\n    @deep: four blanks\n\t@deeper: a tab\n@edge: none\n", ["edge"]),
        ("she typed `@shade: teal` by hand", []),
        ("a `word` and then @shade: teal", ["shade"]),
        ("ring bell@door: never", []),
        ("@Mixed.Case-1: x", ["mixed.case-1"]),
        ("", []),
    ],
)
def test_mentions(spark, text, tags):
    got = column(spark, [text], lambda t: T.extract_tags(t, F.lit(True)))[0]
    assert [r["tag"] for r in got] == tags


def test_strip_tags(spark):
    text = "the rent was @paid: in march\nnext\n@state: dry\nlast"
    assert column(spark, [text], lambda t: T.strip_tags(t, F.lit(True))) == ["the rent was \nnext\nlast"]


def test_tag_block(spark):
    got = column(spark, ["@for: b\n@state:  dry \n\n@after: y"], T.tag_block)[0]
    assert [(r["name"], r["value"]) for r in got] == [("for", "b"), ("state", "dry")]
    assert column(spark, ["@a: 1\n@a: 2"], lambda t: T.tag_block_get(T.tag_block(t), "A")) == ["1"]


def test_tag_definitions_last_wins(spark):
    got = column(spark, ["@tag: x first\nno\n@tag: y other\n@tag: X second"], T.tag_definitions)[0]
    assert got == {"x": "second", "y": "other"}


def test_ranges_and_slices(spark):
    assert column(spark, ["10-20", "p3:4", "", None], T.range_start) == [10, None, None, None]
    assert column(spark, ["10-20", "7"], T.range_end) == [20, None]
    assert column(spark, ["a\nb\nc\nd"], lambda t: T.line_slice(t, F.lit(2), F.lit(3))) == ["b\nc"]


def test_preview(spark):
    text = "one two three four five six seven eight nine ten"
    got = column(spark, [text], lambda t: T.preview(t, "five", 20))[0]
    assert "five" in got and got.startswith("...") and got.endswith("...")
    assert column(spark, ["short"], lambda t: T.preview(t, "x", 20)) == ["short"]


def test_fuzzy_short_queries(spark):
    assert column(spark, ["abcdefgh", "zz"], lambda t: T.fuzzy(F.lit("ab"), t)) == [0.25, 0.0]
    assert column(spark, ["ab"], lambda t: T.fuzzy(F.lit("abcd"), t)) == [0.5]
    assert column(spark, [""], lambda t: T.fuzzy(F.lit("abcd"), t)) == [0.0]


def test_word_overlap_and_floor(spark):
    assert column(spark, ["Slow rivers run"], lambda t: T.word_overlap(F.lit("slow maps"), t)) == [0.5]
    assert column(spark, ["xyz"], lambda t: T.jaccard_with_floor(T.literal_codes("abcdefghijklmnop"), T.gram_codes(t))) == [0.0]


def test_chapter_verse_and_sizes(spark):
    got = column(spark, ["3:16", "x"], T.chapter_verse)
    assert (got[0]["chapter"], got[0]["verse"]) == (3, 16) and got[1] is None
    out = rows(spark, [10, 2048, 5 * 1024**2], "long").select(T.human_size(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in out] == ["10 B", "2.0 KB", "5.0 MB"]


def test_highlight_escapes(spark):
    assert column(spark, ["a <b> & Digest"], lambda t: T.highlight(t, "digest")) == ["a &lt;b&gt; &amp; <mark>Digest</mark>"]
