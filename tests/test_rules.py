"""Globs, tag predicates, dates and recurrences."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorefield.functions import dates as D
from lorefield.functions import globs
from lorefield.functions.predicates import parse_predicate


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("plans/*", "plans/roof.txt", True),
        ("plans/*", "plans/old/roof.txt", False),
        ("**/*.csv", "prices.csv", True),
        ("**/*.csv", "x/y/prices.csv", True),
        ("*.csv", "x/y/prices.csv", True),
        ("./x.md", "x.md", True),
        ("./x.md", "a/x.md", False),
        ("*.{py,go}", "a/m.go", True),
        ("a?c", "abc", True),
        ("[ab]x", "bx", True),
        ("[!ab]x", "bx", False),
        ("a.b", "aXb", False),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.search(globs.glob_to_regex(glob).replace(r"\z", r"\Z"), path)) is hit


def test_directory_globs_and_classes(spark):
    df = spark.createDataFrame([("attic",), ("a.md",), ("b.py",), ("c",), (None,)], "path string")
    assert not df.filter(globs.matches(F.col("path"), "attic/")).count()
    got = [r[0] for r in df.select(globs.classify(F.col("path"), ["*.md"], ["*.md", "*.py"])).collect()]
    assert got == ["unresolved", "included", "excluded", "unresolved", "unresolved"]
    assert [r[0] for r in df.select(globs.passes(F.col("path"), ["*.md"], [])).collect()] == [False, True, False, False, False]


@pytest.mark.parametrize(
    "text, modes",
    [
        ("colour=red", ("exact", "colour", "exact", "red")),
        ("colour:dark red", ("exact", "colour", "contains", "dark red")),
        ("~col~^r.d$", ("regex", "col", "regex", "^r.d$")),
        (":col ur", ("contains", "col ur", "any", "")),
        ("colour=", ("exact", "colour", "exact", "")),
        ("colour:", ("exact", "colour", "any", "")),
        ("colour~", ("exact", "colour", "any", "")),
        ("@colour", ("exact", "colour", "any", "")),
    ],
)
def test_predicates(text, modes):
    p = parse_predicate(text)
    assert (p.name_mode, p.name, p.value_mode, p.value) == modes
    assert parse_predicate(p.canonical()) == p


@pytest.mark.parametrize("text", ["", "=x", "a~(?=x)", r"a~(b)\1", "~[~x"])
def test_bad_predicates(text):
    with pytest.raises((ValueError, re.error)):
        parse_predicate(text)


def test_predicate_on_rows(spark):
    df = spark.createDataFrame([("Status", "done"), ("status", "Done"), ("status", ""), (None, "done"), ("x", None)], "tag string, value string")
    keep = lambda t: [tuple(r) for r in df.filter(parse_predicate(t).on(F.col("tag"), F.col("value"))).collect()]
    assert keep("STATUS=done") == [("Status", "done")]
    assert keep("status=") == [("status", "")]
    assert keep("status:DO") == [("Status", "done"), ("status", "Done")]
    assert keep("~^STAT~one$") == [("Status", "done"), ("status", "Done")]


@pytest.mark.parametrize(
    "spec, after, expected",
    [
        ("every monday at 17:00", "2026-03-01 00:00", "2026-03-02 17:00"),
        ("every Monday at 5pm", "2026-03-01 00:00", "2026-03-02 17:00"),
        ("every monday", "2026-03-02 09:00", "2026-03-09 09:00"),
        ("every weekday at 10:00", "2026-03-06 12:00", "2026-03-09 10:00"),
        ("every weekend at 10:00", "2026-03-02 12:00", "2026-03-07 10:00"),
        ("every 31st of the month", "2026-03-31 10:00", "2026-05-31 09:00"),
        ("every 3rd monday", "2026-03-17 00:00", "2026-04-20 09:00"),
        ("every first friday at 8:30", "2026-03-01 00:00", "2026-03-06 08:30"),
        ("every 15m", "2026-03-01 10:20", "2026-03-01 10:30"),
        ("every 2h", "2026-03-01 10:20", "2026-03-01 12:00"),
        ("03-01", "2026-03-02 00:00", "2027-03-01 09:00"),
        ("02-29", "2026-03-02 00:00", "2028-02-29 09:00"),
        ("sometimes", "2026-03-02 00:00", None),
        ("every 99th monday", "2026-03-02 00:00", None),
        ("", "2026-03-02 00:00", None),
    ],
)
def test_next_occurrence(spec, after, expected):
    got = D.next_occurrence(spec, datetime.fromisoformat(after))
    assert got == (datetime.fromisoformat(expected) if expected else None)


def test_bound_on_next_occurrence():
    assert D.next_occurrence("every monday", datetime(2026, 3, 1), datetime(2026, 3, 2, 8)) is None


@pytest.mark.parametrize(
    "value, low, high, rest",
    [
        ("from 2027-02-03 to 2027-09-20 every friday at 7am", "2027-02-03", "2027-09-20", "every friday at 7am"),
        ("2026-03-01..2026-05-30 every Monday", "2026-03-01", "2026-05-30", "every Monday"),
        ("every Monday until 2026-05-30", None, "2026-05-30", "every Monday"),
        ("every Monday", None, None, "every Monday"),
        ("no rule", None, None, "no rule"),
    ],
)
def test_bounds(value, low, high, rest):
    a, b, r = D.bounds(value)
    assert (a and a.isoformat(), b and b.isoformat(), r) == (low, high, rest)


def test_ranges_and_reschedule():
    start, end, whole, text = D.parse_range("2026-05-01 14:30..16:00 review")
    assert (start, end, whole, text) == (datetime(2026, 5, 1, 14, 30), datetime(2026, 5, 1, 16), False, "review")
    assert D.parse_range("2026-05-01..2026-05-03 trip")[1] == datetime(2026, 5, 4)
    assert D.parse_range("2026-13-01") is None and D.parse_range("soon") is None
    assert D.reschedule("2026-05-01 call home", "2026-06-02") == "2026-06-02 call home"
    with pytest.raises(ValueError):
        D.reschedule("call home", "2026-06-02")


def test_next_occurrences_column(spark):
    df = spark.createDataFrame([("every monday",), (None,), ("never",)], "spec string")
    got = [r[0] for r in df.select(D.next_occurrences("spec", F.lit("2026-03-01").cast("timestamp_ntz"))).collect()]
    assert got == [datetime(2026, 3, 2, 9), None, None]


def test_acks(spark):
    df = spark.createDataFrame([("..2026-07-10",), ("2026-07-01..2026-07-10 ok",), ("2026-07-05",), ("later",)], "v string")
    day = F.lit("2026-07-05").cast("date")
    got = [r[0] for r in df.select(D.covers(D.ack_interval(F.col("v")), day)).collect()]
    assert got == [True, True, True, False]
