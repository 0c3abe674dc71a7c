"""Search specifications: a filter stack parsed at plan time and compiled to semi- and anti-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.functions import globs
from lorefield.functions import text as T
from lorefield.functions.predicates import checked_regex, parse_predicate

MODES = ("contains", "fuzzy", "regex", "tag", "file-tag", "files", "about")


@dataclass(frozen=True)
class FilterRow:
    """One row of the stack: ``with`` or ``without``, a mode and its argument."""

    mode: str
    query: str
    without: bool = False
    k: int = 200

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown filter mode {self.mode!r}")
        if self.mode == "regex":
            checked_regex(self.query)
        if self.mode in ("tag", "file-tag"):
            parse_predicate(self.query)


def parse_stack(words: list[str]) -> list[FilterRow]:
    """Rows of a command line: bare words join into one ``contains``; polarity stays until it changes.

    ``-with`` and ``-without`` set the polarity, ``-<mode> ARG`` adds a row, ``-filter-k N`` sets the size of
    the next ``about`` row.
    """
    rows: list[FilterRow] = []
    bare: list[str] = []
    without, k, i = False, 200, 0

    def flush() -> None:
        if bare:
            rows.append(FilterRow("contains", " ".join(bare), without))
            bare.clear()

    while i < len(words):
        w = words[i]
        name = w.lstrip("-") if w.startswith("-") else ""
        if name in ("with", "without"):
            flush()
            without = name == "without"
        elif name == "filter-k" or name in MODES:
            if i + 1 >= len(words):
                raise ValueError(f"{w} needs an argument")
            flush()
            i += 1
            if name == "filter-k":
                k = int(words[i])
            else:
                rows.append(FilterRow(name, words[i], without, k))
                k = 200
        elif name:
            raise ValueError(f"unknown flag {w}")
        else:
            bare.append(w)
        i += 1
    flush()
    return rows


@dataclass(frozen=True)
class SearchSpec:
    """A whole search; incompatible options are refused when it is made."""

    contains: str = ""
    regex: tuple[str, ...] = ()
    like_file: str = ""
    about: str = ""
    fuzzy: bool = False
    multi: bool = False
    score: str = ""
    k: int = 20
    filters: tuple[FilterRow, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    default_exclude: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.like_file and (self.contains or self.regex):
            raise ValueError("like_file excludes contains and regex")
        if self.multi and self.score:
            raise ValueError("multi excludes score")
        if self.fuzzy and (self.multi or self.score or self.about):
            raise ValueError("fuzzy excludes multi, score and split searches")
        if self.score not in ("", "coverage", "density", "overlap", "bm25"):
            raise ValueError(f"unknown score {self.score!r}")
        if not 1 <= self.k <= 10_000:
            raise ValueError("k must be between 1 and 10000")

    def paths(self) -> tuple[list[str], list[str]]:
        """Include and exclude globs; the defaults apply only if the search names none."""
        if self.include or self.exclude:
            return list(self.include), list(self.exclude)
        return [], list(self.default_exclude)


def text_condition(row: FilterRow, text: Column) -> Column | None:
    """The condition of a row that only needs the chunk's text; null for other modes.

    A text that is missing passes a positive row and is kept by a negative one.
    """
    if row.mode == "contains":
        hit = F.contains(F.lower(text), F.lit(row.query.lower()))
    elif row.mode == "fuzzy":
        hit = T.fuzzy(F.lit(row.query), text) >= 0.01
    elif row.mode == "regex":
        hit = text.rlike(row.query)
    else:
        return None
    return F.coalesce(~hit if row.without else hit, F.lit(True))


def apply_filters(chunks: DataFrame, rows: list[FilterRow], tags: DataFrame, about: dict[str, DataFrame] | None = None) -> DataFrame:
    """Chunks that pass every row: conditions first, then semi- or anti-joins for the rest.

    ``about`` gives the chunk ids near each ``about`` query; an empty set of a positive row filters
    everything out.
    """
    out = chunks
    for r in rows:
        cond = text_condition(r, F.col("text"))
        if cond is None and r.mode == "files":
            hit = F.coalesce(globs.matches(F.col("path"), r.query), F.lit(False))
            cond = ~hit if r.without else hit
        if cond is not None:
            out = out.filter(cond)
    for r in rows:
        how = "left_anti" if r.without else "left_semi"
        if r.mode in ("tag", "file-tag"):
            ids = tags.filter(parse_predicate(r.query).on(F.col("tag"), F.col("value"))).select("chunk_id").filter("chunk_id is not null").distinct()
            if r.mode == "tag":
                out = out.join(ids, "chunk_id", how)
            else:
                paths = chunks.join(ids, "chunk_id", "left_semi").select("path").filter("path is not null").distinct()
                out = out.join(paths, "path", how)
        elif r.mode == "about":
            near = (about or {})[r.query].select("chunk_id").distinct()
            out = out.join(near, "chunk_id", how)
    return out
