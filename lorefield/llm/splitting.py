"""Splitting oversized texts at line ends, with a one-line overlap.

A text's line lengths give prefix sums, and the line ends are the sorted boundary array: the end of a
piece is the last boundary under the limit, found by binary search. The next piece steps back by one
line if that line and the next fit together. A line over the limit is cut inside: at the last blank
under the limit, or hard where there is none.

Edge cases: null texts and ids and texts within the limit give no pieces; a repeated row counts once
(ties between equal pieces can't arise: pieces of one record differ in their first line); a range
that isn't digits-digits, or whose number doesn't fit 63 bits, numbers lines from 1; a text that ends
in a newline has an empty last line; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
RANGE = re.compile(r"([0-9]+)-[0-9]+")


def first_line(chunk_range: str | None) -> int:
    """The line number a text begins at, from its range."""
    m = RANGE.fullmatch(chunk_range) if chunk_range else None
    return n if m and (n := int(m[1])) < 1 << 62 else 1


def line_pieces(lengths: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Pieces as (first, last) index into ``lengths``, the lines' lengths without their newlines."""
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])  # ends[k]: characters before line k
    out, at, n = [], 0, len(lengths)
    while at < n:
        # the lines at..last take ends[last + 1] - 1 - ends[at] characters
        last = int(np.searchsorted(ends, ends[at] + limit + 1, side="right")) - 2
        if last < at:  # the line itself is over the limit
            out.append((at, at))
            at += 1
            continue
        last = min(last, n - 1)
        out.append((at, last))
        if last + 1 >= n:
            break
        pair = ends[last + 2] - 1 - ends[last]
        at = last if last > at and pair <= limit else last + 1
    return out


def cuts(line: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Cut a line over the limit into [start, end) parts, each at most ``limit`` long.

    A part ends behind the last blank under the limit; where there is none, the cut is hard.
    """
    blanks = np.array([m.end() for m in re.finditer(r"\s", line)], dtype=np.int64)
    out, at = [], 0
    while len(line) - at > limit:
        k = int(np.searchsorted(blanks, at + limit, side="right")) - 1
        end = int(blanks[k]) if k >= 0 and blanks[k] > at else at + limit
        out.append((at, end))
        at = end
    return [*out, (at, len(line))]


def split_text(text: str, limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """(first line, last line, start, end) of every piece, 0-based, ends of lines inclusive."""
    lines = text.split("\n")
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = []
    for a, b in line_pieces(lengths, limit):
        if lengths[a] > limit:
            out += [(a, a, int(begin[a]) + s, int(begin[a]) + e) for s, e in cuts(lines[a], limit)]
        else:
            out.append((a, b, int(begin[a]), int(begin[b] + lengths[b])))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, low, high = [], [], []
        for i, rng, text in zip(batch.column("id").to_pylist(), batch.column("rng").to_pylist(), batch.column("text").to_pylist()):
            base = first_line(rng)
            lengths = np.fromiter(map(len, text.split("\n")), dtype=np.int64)
            for a, b in line_pieces(lengths):
                ids.append(i)
                low.append(base + a)
                high.append(base + b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["id", "lo", "hi"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, rng, text in zip(batch.column("id").to_pylist(), batch.column("rng").to_pylist(), batch.column("text").to_pylist()):
            base = first_line(rng)
            rows += [(i, n, base + a, base + b, s, text[s:e]) for n, (a, b, s, e) in enumerate(split_text(text))]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "piece", "lo", "hi", "start_pos", "text"])


def oversized(rows: DataFrame, id_col: str, range_col: str, text_col: str, limit: int = LIMIT) -> DataFrame:
    """(id, rng, text) of the texts over the limit; the length test runs before any Python."""
    return (
        rows.filter(F.col(id_col).isNotNull() & (F.length(text_col) > limit))
        .select(F.col(id_col).cast("long").alias("id"), F.col(range_col).alias("rng"), F.col(text_col).alias("text"))
    )


def piece_ranges(rows: DataFrame, id_col: str, range_col: str, text_col: str, src: str) -> DataFrame:
    """(src, rec_id, line_from, line_to): the line range of every piece of every oversized text."""
    out = oversized(rows, id_col, range_col, text_col).mapInArrow(_found, "id long, lo long, hi long").distinct()
    return out.select(F.lit(src).alias("src"), F.col("id").alias("rec_id"), F.col("lo").alias("line_from"), F.col("hi").alias("line_to"))


def pieces(rows: DataFrame, id_col: str, range_col: str, text_col: str, src: str) -> DataFrame:
    """Every piece with its text; the cuts of an oversized line are pieces of their own."""
    out = oversized(rows, id_col, range_col, text_col).mapInArrow(_pieces, "id long, piece long, lo long, hi long, start_pos long, text string")
    out = out.dropDuplicates(["id", "piece"])
    return out.select(F.lit(src).alias("src"), F.col("id").alias("rec_id"), "piece", F.col("lo").alias("line_from"), F.col("hi").alias("line_to"), (F.col("start_pos") + 1).alias("start_pos"), "text")
