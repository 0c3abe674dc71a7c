"""Listings, chunkers, chat lines and sinks."""

import json
import os

from pyspark.sql import functions as F

from lorefield.sources import chat, chunkers, listing, sinks


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("x")
    (tmp_path / "a/y.py").write_text("y")
    (tmp_path / "z.md").write_text("")
    (tmp_path / "q.bin").write_text("q")
    got = {r["path"]: r["class"] for r in listing.scan(spark, str(tmp_path), ["*.md"], ["*.py"]).collect()}
    assert got == {"a/x.md": "included", "a/y.py": "excluded", "q.bin": "unresolved"}
    assert listing.expand_sources([str(tmp_path / "*"), str(tmp_path / "none*")]) == ([str(tmp_path / "a")], [str(tmp_path / "none*")])


def test_strategy_longest_pattern_wins(spark):
    df = spark.createDataFrame([("specs/a.md",), ("a.md",), ("b",)], "path string")
    got = [r[0] for r in df.select(listing.strategy_for(F.col("path"), {"*.md": "markdown", "specs/*.md": "spec"})).collect()]
    assert got == ["spec", "markdown", "lines"]


def test_status_and_changes(spark):
    old = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, None)], "path string, length long, hash string")
    now = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("d", 1, None)], "path string, length long, hash string")
    assert {r["path"]: r["code"] for r in listing.status(old, now).collect()} == {"a": "G", "b": "S", "c": "M", "d": "N"}
    df = spark.createDataFrame([("abcd", "ab"), ("ab", "ab"), ("xbcd", "ab"), ("a", "ab")], "now string, was string")
    kind = listing.change_kind(F.col("now"), F.length("was"), F.sha2("was", 256))
    assert [r[0] for r in df.select(kind).collect()] == ["append", "unchanged", "changed", "changed"]


def test_config_diff_and_rules(spark):
    a = spark.createDataFrame([("case", "1"), ("k", "2")], "key string, value string")
    b = spark.createDataFrame([("case", "2"), ("k", "2"), ("tag_model", "m")], "key string, value string")
    assert {tuple(r) for r in listing.diff_config(a, b).collect()} == {("case", "changed", "defer"), ("tag_model", "added", "minimal")}
    df = spark.createDataFrame([("notes/a.md",)], "path string")
    r = listing.explain_rules(df, [("include", "*.md", "user"), ("exclude", "notes/*", "default")]).first()
    assert r["rules"] == "include:*.md@user|exclude:notes/*@default" and r["conflict"]


def test_paragraphs_brackets_and_indents():
    assert chunkers.paragraph_chunks("# t\nbody\n\nnext\n# u\nx") == [(1, 2), (4, 4), (5, 6)]
    assert chunkers.paragraph_chunks("\n\n") == []
    code = "// about f\nfunc f() {\n  if (x) { g(\"}\") }\n}\n\nvar a = 1\nfunc g() {}\n"
    assert chunkers.bracket_chunks(code) == [(1, 4), (6, 7)]
    py = "# about f\ndef f():\n    return 1\n\nx = 1\ndef g():\n    pass\n"
    assert chunkers.indent_chunks(py) == [(1, 3), (5, 5), (6, 7)]


def test_code_chunks_and_registry(spark):
    chunkers.register_chunker("whole", lambda t: [(1, t.count("\n") + 1)])
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r) for r in chunkers.code_chunks(df, "id", "text", "whole").collect()] == [(1, 1, "1-2", "a\nb")]
    assert [tuple(r) for r in chunkers.line_chunks(df, "id", "text").orderBy("no").collect()] == [(1, 1, "1-1", "a"), (1, 2, "2-2", "b")]


def test_chat_lines(spark):
    lines = [
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}]}},
        {"type": "user", "message": {"content": "hello"}, "timestamp": "2026"},
        {"type": "progress", "message": {"content": "no"}},
        {"type": "user", "message": {"content": "Base directory for this skill: /x/skills/tidy"}},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",), (None,)], "line string")
    got = [(r["role"], r["text"], r["skill"]) for r in chat.chat_chunks(df).collect()]
    assert got == [("assistant", "hm\nok", None), ("user", "hello", None), ("user", "Base directory for this skill: /x/skills/tidy", "tidy")]
    assert [r["body"] for r in chat.transcript(df).collect()] == ["ok"]
    assert [r["body"] for r in chat.transcript(df, thinking=True).collect()] == ["hm", "ok"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a&b", "1-2", 0.5, "t")], "path string, rng string, score double, text string")
    r = df.select(sinks.location(F.col("path"), F.col("rng")), sinks.wrapped("c", F.col("path"), F.col("text")), sinks.markdown_item(F.col("path"), F.col("rng"), F.col("score"))).first()
    assert tuple(r) == ("a&b:1-2", '<c path="a&amp;b">\nt\n</c>', "- `a&b:1-2` (0.500)")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert any(f.endswith(".json") for f in os.listdir(tmp_path / "out"))
