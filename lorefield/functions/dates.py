"""Dates and recurrences of tag values.

The ISO forms, ranges, acknowledgements and the schedulable test are column expressions. The full
recurrence grammar is parsed in Python: ``parse_rule`` turns a specification into a small rule, and
rules yield occurrences one after the other. ``next_occurrences`` is the Arrow form for columns; equal
specifications of a batch are parsed once.

Decisions: times are ``HH:MM`` or with am/pm, 09:00 if none is given; ``first`` is an ordinal like
``1st``; an ordinal day that a month lacks is skipped, not moved into the next month; all times are
without a zone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lorefield.functions import text as T

DAYS = {n: i for i, names in enumerate(("monday mon", "tuesday tue tues", "wednesday wed", "thursday thu thur thurs", "friday fri", "saturday sat", "sunday sun")) for n in names.split()}
ORDINALS = {n: i for i, n in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth".split(), 1)}
START_WORDS = "from|starting|since|after|beginning"
END_WORDS = "to|until|till|by|through|ending|before"


def looks_schedulable(value: Column) -> Column:
    """Whether a value begins like a date or a recurrence."""
    v = F.lower(T.strip(value))
    return v.rlike(r"^(?:.{4}[-/].{2}[-/].{2}|.{2}[-/].{2}|every )")


def iso_date(value: Column) -> Column:
    """The ISO date a value begins with; null if it has none or an impossible one."""
    return F.try_to_timestamp(F.regexp_extract(T.strip(value), r"^(\d{4}-\d\d-\d\d)", 1), F.lit("yyyy-MM-dd")).cast("date")


def ack_interval(value: Column) -> Column:
    """(start, end) of an acknowledgement: ``..D``, ``A..B`` or ``D``; an open start is null."""
    v = F.regexp_replace(value, r"^[\s ]+", "")
    day = r"(\d{4}-\d\d-\d\d)"
    at = lambda p, i: F.try_to_timestamp(F.regexp_extract(v, p, i), F.lit("yyyy-MM-dd")).cast("date")
    left_open, closed, single = rf"^\.\.\s*{day}", rf"^{day}\s*\.\.\s*{day}", rf"^{day}"
    start = F.when(v.rlike(left_open), None).when(v.rlike(closed), at(closed, 1)).otherwise(at(single, 1))
    end = F.when(v.rlike(left_open), at(left_open, 1)).when(v.rlike(closed), at(closed, 2)).otherwise(at(single, 1))
    return F.struct(start.alias("start"), end.alias("end"))


def covers(interval: Column, day: Column) -> Column:
    """Whether an acknowledgement's interval covers a day."""
    return F.coalesce((interval["start"].isNull() | (interval["start"] <= day)) & (day <= interval["end"]), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """``kind`` is day, weekday, weekend, month_day, nth_day, minutes, hours or yearly."""

    kind: str
    n: int = 0
    day: int = 0
    at: time = time(9, 0)


def _clock(text: str) -> time | None:
    m = re.fullmatch(r"(\d{1,2})(?::(\d\d))?\s*(am|pm)?", text.strip(), re.I)
    if not m or not (m[2] or m[3]):
        return None
    hour, minute = int(m[1]), int(m[2] or 0)
    if m[3]:
        hour = hour % 12 + (12 if m[3].lower() == "pm" else 0)
    return time(hour, minute) if hour < 24 and minute < 60 else None


@lru_cache(maxsize=50_000)
def parse_rule(spec: str) -> Rule | None:
    """The rule of a recurrence specification, or null if it has none."""
    body = spec.split(" -- ")[0].strip().lower()
    m = re.fullmatch(r"(\d\d)[-/](\d\d)(?:\s.*)?", body)
    if m and 1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 31:
        return Rule("yearly", int(m[1]), int(m[2]))
    if not body.startswith("every "):
        return None
    what, at = body[6:].strip(), time(9, 0)
    if " at " in what:
        what, _, clock = what.rpartition(" at ")
        at, what = _clock(clock) or at, what.strip()
    if what in DAYS:
        return Rule("day", day=DAYS[what], at=at)
    if what in ("weekday", "weekend"):
        return Rule(what, at=at)
    m = re.fullmatch(r"(\d+)\s*([mh])", what)
    if m and int(m[1]) > 0:
        return Rule("minutes" if m[2] == "m" else "hours", int(m[1]))
    m = re.match(r"(?:(\d+)(?:st|nd|rd|th)?|([a-z]+))\s+(.*)", what)
    n = (int(m[1]) if m[1] else ORDINALS.get(m[2], 0)) if m else 0
    if n:
        if "of the month" in m[3] or m[3] == "":
            return Rule("month_day", n, at=at) if n <= 31 else None
        if m[3].strip() in DAYS:
            return Rule("nth_day", n, DAYS[m[3].strip()], at) if n <= 5 else None
    return None


def _months(start: date) -> Iterator[tuple[int, int]]:
    y, m = start.year, start.month
    while True:
        yield y, m
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)


def occurrences(rule: Rule, after: datetime) -> Iterator[datetime]:
    """Occurrences strictly after a time, without end."""
    if rule.kind in ("minutes", "hours"):
        floor = after.replace(minute=0, second=0, microsecond=0) if rule.kind == "minutes" else datetime.combine(after.date(), time())
        step = timedelta(minutes=rule.n) if rule.kind == "minutes" else timedelta(hours=rule.n)
        at = floor + ((after - floor) // step + 1) * step
        while True:
            yield at
            at += step
    elif rule.kind in ("day", "weekday", "weekend"):
        wanted = {rule.day} if rule.kind == "day" else set(range(5)) if rule.kind == "weekday" else {5, 6}
        day = after.date()
        while True:
            at = datetime.combine(day, rule.at)
            if day.weekday() in wanted and at > after:
                yield at
            day += timedelta(days=1)
    else:
        for y, m in _months(after.date()):
            if y > 9000:
                return
            try:
                if rule.kind == "month_day":
                    day = date(y, m, rule.n)
                elif rule.kind == "yearly":
                    if m != rule.n:
                        continue
                    day = date(y, m, rule.day)
                else:
                    first = date(y, m, 1)
                    day = first + timedelta(days=(rule.day - first.weekday()) % 7 + 7 * (rule.n - 1))
                    if day.month != m:
                        continue
            except ValueError:
                if rule.kind == "yearly" and rule.day > 29:
                    return
                continue
            at = datetime.combine(day, rule.at)
            if at > after:
                yield at


def next_occurrence(spec: str | None, after: datetime | None, not_after: datetime | None = None) -> datetime | None:
    """The next occurrence of a specification after a time, unless it is past the bound."""
    rule = parse_rule(spec) if spec and after else None
    at = next(occurrences(rule, after), None) if rule else None
    return None if at is None or (not_after is not None and at > not_after) else at


@F.pandas_udf(TimestampNTZType())
def next_occurrences(spec: pd.Series, after: pd.Series) -> pd.Series:
    """Column form of ``next_occurrence``."""
    out = [next_occurrence(s, None if pd.isna(a) else a.to_pydatetime()) for s, a in zip(spec, after)]
    return pd.Series(out, dtype="datetime64[us]")


def expand(spec: str, start: datetime, end: datetime) -> list[datetime]:
    """All occurrences in [start, end]."""
    rule = parse_rule(spec)
    out: list[datetime] = []
    if rule:
        for at in occurrences(rule, start - timedelta(microseconds=1)):
            if at > end:
                break
            out.append(at)
    return out


_ISO = r"\d{4}[-/]\d\d[-/]\d\d"


def bounds(value: str) -> tuple[date | None, date | None, str]:
    """(not before, not after, rest) of a recurrence with bounds before or behind it.

    Bounds are ``A..B``, or a word such as *from* or *until* and an ISO date.
    """
    low = high = None
    rest = value.strip()
    if "every " not in rest.lower():
        return None, None, rest
    m = re.search(rf"({_ISO})\s*\.\.\s*({_ISO})", rest)
    if m:
        low, high = (date.fromisoformat(x.replace("/", "-")) for x in m.groups())
        rest = rest[: m.start()] + rest[m.end() :]
    for words, is_low in ((START_WORDS, True), (END_WORDS, False)):
        m = re.search(rf"\b(?:{words})\s+({_ISO})", rest, re.I)
        if m and (low if is_low else high) is None:
            day = date.fromisoformat(m[1].replace("/", "-"))
            low, high = (day, high) if is_low else (low, day)
            rest = rest[: m.start()] + rest[m.end() :]
    return low, high, " ".join(rest.split())


def parse_range(value: str, default_minutes: int = 0) -> tuple[datetime, datetime, bool, str] | None:
    """(start, end, all day, description) of a dated value.

    ``2026-05-01``, ``2026-05-01 14:30``, ``A..B``, ``2026-05-01 14:30..16:00``, ``N days later`` behind a
    first date; what follows is the description. Null if the value doesn't begin with a date.
    """
    m = re.match(rf"\s*({_ISO})(?:[T ]+(\d{{1,2}}:\d\d(?:\s*[ap]m)?))?(?:\s*\.\.\s*(?:({_ISO})(?:[T ]+(\d{{1,2}}:\d\d))?|(\d{{1,2}}:\d\d)|(\d+)\s+days?\s+later))?\s*(.*)", value, re.I | re.S)
    if not m:
        return None
    try:
        day = date.fromisoformat(m[1].replace("/", "-"))
        clock = _clock(m[2]) if m[2] else None
        start = datetime.combine(day, clock or time())
        all_day = clock is None
        if m[3]:
            end_day, end_clock = date.fromisoformat(m[3].replace("/", "-")), _clock(m[4]) if m[4] else None
            end = datetime.combine(end_day, end_clock) if end_clock else datetime.combine(end_day, time()) + timedelta(days=1)
        elif m[5]:
            end = datetime.combine(day, _clock(m[5]) or time())
        elif m[6]:
            end = start + timedelta(days=int(m[6]))
        else:
            end = start + (timedelta(days=1) if all_day else timedelta(minutes=default_minutes))
    except ValueError:
        return None
    return start, end, all_day, m[7].strip()


def reschedule(value: str, start: str, end: str = "") -> str:
    """A dated value with another date part; the description stays."""
    got = parse_range(value)
    if got is None:
        raise ValueError(f"no date in {value!r}")
    head = start if not end else f"{start}..{end}"
    return f"{head} {got[3]}".strip()
