"""Chunkers: texts into chunks with their line ranges.

The line chunker is an expression. Those that need a scanner with memory (paragraphs under headings,
bracketed and indented code) run as Arrow batches; each is a pure function of one text, registered by
name, so that others can be added.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, location, text): one chunk per line that isn't empty."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "text"))
    no = F.col("at") + 1
    return lines.filter("text <> ''").select(key, no.alias("no"), F.format_string("%d-%d", no, no).alias("location"), "text")


@dataclass(frozen=True)
class Language:
    """What a code chunker needs to know: brackets, string delimiters and line comments."""

    brackets: tuple[tuple[str, str], ...] = (("{", "}"), ("(", ")"), ("[", "]"))
    quotes: tuple[str, ...] = ('"', "'")
    comments: tuple[str, ...] = ("//", "#")


def bracket_chunks(text: str, language: Language = Language()) -> list[tuple[int, int]]:
    """(first, last) lines of top-level definitions, each with the comment lines right above it.

    A definition begins at depth 0 and ends on the line that closes its last bracket; lines without
    brackets are gathered up to the next blank line.
    """
    opens, closes = {a for a, _ in language.brackets}, {b for _, b in language.brackets}
    depth, quote, begin, out = 0, "", None, []
    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare and depth == 0:
            if begin is not None:
                out.append((begin, no - 1))
            begin, quote = None, ""
            continue
        if begin is None:
            begin = no
        i, opened = 0, depth
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\":
                    i += 1
                elif line.startswith(quote, i):
                    quote = ""
            elif any(line.startswith(m, i) for m in language.comments):
                break
            elif c in language.quotes:
                quote = c
            elif c in opens:
                depth += 1
            elif c in closes:
                depth = max(0, depth - 1)
            i += 1
        quote = ""  # strings end with their line
        if depth == 0 and (opened > 0 or any(c in closes for c in line)) and not any(bare.startswith(m) for m in language.comments):
            out.append((begin, no))
            begin = None
    if begin is not None:
        out.append((begin, len(lines)))
    return out


def indent_chunks(text: str, language: Language = Language()) -> list[tuple[int, int]]:
    """(first, last) lines of blocks that begin at the left margin and own the deeper lines below them."""
    lines = text.split("\n")
    out, begin, last, in_comment = [], None, 0, False
    for no, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare:
            continue
        comment = any(bare.startswith(m) for m in language.comments)
        top = not line[0].isspace()
        if top and begin is not None and not in_comment:
            out.append((begin, last))
            begin = None
        if begin is None:
            begin = no
        in_comment = top and comment
        last = no
    if begin is not None:
        out.append((begin, last))
    return out


def paragraph_chunks(text: str) -> list[tuple[int, int]]:
    """(first, last) lines of runs between blank lines; a heading begins a chunk of its own."""
    out, begin, last = [], None, 0
    for no, line in enumerate(text.split("\n"), 1):
        heading = re.match(r"#{1,6}\s", line)
        if begin is not None and (heading or not line.strip()):
            out.append((begin, last))
            begin = None
        if line.strip():
            begin = no if begin is None else begin
            last = no
    return [*out, (begin, last)] if begin is not None else out


def chat_line_range(previous: int, count: int) -> tuple[int, int]:
    """Range of ``count`` lines behind line ``previous``."""
    return previous + 1, previous + count


CHUNKERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"paragraph": paragraph_chunks, "bracket": bracket_chunks, "indent": indent_chunks}


def register_chunker(name: str, chunker: Callable[[str], list[tuple[int, int]]]) -> None:
    """Add a chunker: a function from a text to (first, last) lines."""
    CHUNKERS[name] = chunker


def code_chunks(rows: DataFrame, key: str, text: str, chunker: str) -> DataFrame:
    """(key, no, location, text) by a registered chunker; null and empty texts give no chunks."""
    split = CHUNKERS[chunker]
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body:
                    lines = body.split("\n")
                    out += [(k, n, f"{a}-{b}", "\n".join(lines[a - 1 : b])) for n, (a, b) in enumerate(split(body), 1)]
            cols = list(zip(*out)) if out else [()] * 4
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k", "no", "location", "text"])

    slim = rows.select(F.col(key).alias("k"), F.col(text).alias("body"))
    return slim.mapInArrow(run, f"k {kind}, no int, location string, text string").withColumnRenamed("k", key)
