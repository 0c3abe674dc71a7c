"""Exact vector search on a grid of cells.

Targets are dealt out over the rows of a grid, queries over its columns, so that a cell holds about ``CELL``
vectors of either side: each target goes to every column, each query to every row, and every pair meets in exactly
one cell. The cells are an equi-join on their number (a cogroup), so neither side is collected, broadcast or paired
by a nested loop, and a cell's size doesn't grow with the data. Within a cell a block of targets is one matrix product
in numpy; groups are reduced by ``reduceat``, and only what can be among the best leaves the cell.

Zero norms score 0; vectors of another length than the query's are skipped; null vectors, null groups and vectors with a
null in them take no part. Ties are broken by the target's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = 8192
#: Scores that a cell computes at once.
AT_ONCE = 1 << 22


def _grid(targets: DataFrame, queries: DataFrame, target_key: str, query_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of their cell; the sizes of the sides (two counts) give the grid."""
    rows, cols = (max(1, math.ceil(side.count() / CELL)) for side in (targets, queries))
    row, col = F.pmod(F.xxhash64(target_key), F.lit(rows)), F.pmod(F.xxhash64(query_key), F.lit(cols))
    t = targets.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: row * cols + c)))
    q = queries.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * cols + col)))
    return t, q


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, pa.Table]]:
    """Unit vectors by their length, with the rows they belong to."""
    sizes = pc.list_value_length(rows["vec"]).to_numpy()
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        own = rows.filter(pa.array(sizes == dim))
        m = pa.concat_arrays(own["vec"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        whole = ~np.isnan(m).any(1)
        m, own = m[whole], own.filter(pa.array(whole))
        size = np.sqrt((m * m).sum(1))
        out[dim] = m / np.where(size == 0, 1, size)[:, None], own
    return out


def _grouped(rows: pa.Table, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, begin of each group, ids, vectors), sorted by group and id."""
    names, of = np.unique(np.array(rows["grp"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    ids = rows["id"].to_numpy()
    order = np.lexsort((ids, of))
    return names, np.searchsorted(of[order], np.arange(len(names))), ids[order], m[order]


def _blocks(n: int, queries: int) -> Iterator[tuple[int, int]]:
    step = max(16, AT_ONCE // max(queries, 1))
    return ((a, min(n, a + step)) for a in range(0, n, step))


def _first(keep: np.ndarray, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the rows that are among the first ``keep`` of their group."""
    by = np.lexsort((*order[::-1], group))
    begin = np.searchsorted(group[by], np.arange(len(keep)))
    return by[np.arange(len(by)) - begin[group[by]] < keep[group[by]]]


def _best(least: float | None, digits: int):
    def run(targets: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        left, right = _matrices(queries), _matrices(targets)
        for dim in left.keys() & right.keys():
            (q, own), (t, rows) = left[dim], right[dim]
            names, begin, _, q = _grouped(own, q)
            keep = np.zeros(len(names), np.int64)
            np.maximum.at(keep, np.searchsorted(names, np.array(own["grp"].to_pylist(), dtype=object).astype(str)), own["keep"].to_numpy())
            ids = rows["id"].to_numpy()
            parts = []
            for a, b in _blocks(len(t), len(q)):
                score = np.maximum.reduceat(np.round(q @ t[a:b].T, digits), begin, axis=0)
                k = min(int(keep.max()), b - a)
                floor = np.partition(score, b - a - k, axis=1)[:, b - a - k]
                hit = score >= floor[:, None] if least is None else (score >= floor[:, None]) & (score > least)
                g, i = np.nonzero(hit)
                parts.append((g, ids[a + i], score[g, i]))
            g, i, s = (np.concatenate(x) for x in zip(*parts))
            top = _first(keep, g, -s, i)
            found.append((names[g[top]], i[top], s[top]))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, object), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"grp": pa.array(cols[0].astype(object), pa.string()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def _slim(rows: DataFrame, group: str | None, key: str, vec: str) -> DataFrame:
    grp = [] if group is None else [F.col(group).cast("string").alias("grp")]
    out = rows.select(*grp, F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec")).filter("vec is not null")
    return out if group is None else out.filter("grp is not null")


def top_k(
    targets: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    key: str = "id",
    vec: str = "vec",
    group: str = "grp",
    query_key: str = "qid",
    least: float | None = None,
    skip_same: bool = False,
    digits: int = 9,
) -> DataFrame:
    """(grp, id, score, rank): the ``k`` best targets of every query group, by the maximum over its queries.

    ``least`` drops scores at or below it; ``skip_same`` drops a target with the id of one of the group's queries.
    """
    t, q = _slim(targets, None, key, vec), _slim(queries, group, query_key, vec)
    keep = F.lit(k).cast("long")
    if skip_same:  # as many candidates more as can be dropped
        q = q.join(q.groupBy("grp").agg(F.count("*").alias("own")), "grp")
        keep = F.col("own") + k
    t, q = _grid(t, q.select("grp", "id", "vec", keep.alias("keep")), "id", "id")
    # a target's best score is reached in the cell of the query that gives it, so no candidate is lost
    found = t.groupBy("cell").cogroup(q.groupBy("cell")).applyInArrow(_best(least, digits), "grp string, id long, score double")
    best = found.groupBy("grp", "id").agg(F.max("score").alias("score"))
    if skip_same:
        best = best.join(queries.select(F.col(group).cast("string").alias("grp"), F.col(query_key).cast("long").alias("id")).distinct(), ["grp", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.asc("id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _pair_best(k: int | None, digits: int):
    def run(right: pa.Table, left: pa.Table) -> pa.Table:
        found: list[tuple] = []
        of_left, of_right = _matrices(left), _matrices(right)
        for dim in of_left.keys() & of_right.keys():
            names, begin, ids, q = _grouped(of_left[dim][1], of_left[dim][0])
            others, other_begin, other_ids, t = _grouped(of_right[dim][1], of_right[dim][0])
            own = np.searchsorted(begin, np.arange(len(q)), side="right") - 1
            other = np.searchsorted(other_begin, np.arange(len(t)), side="right") - 1
            parts = []
            for a, b in _blocks(len(t), len(q)):
                score = np.round(q @ t[a:b].T, digits)
                cut = np.flatnonzero(np.concatenate([[True], other[a + 1 : b] != other[a : b - 1]]))
                top = np.maximum.reduceat(np.maximum.reduceat(score, begin, axis=0), cut, axis=1)
                at = other[a:b] - other[a]
                r, c = np.nonzero(score == top[own][:, at])
                # row by row, so the first hit of a pair has the smallest source, and of that the smallest target
                pair, first = np.unique(own[r] * len(others) + other[a + c], return_index=True)
                parts.append((pair, score[r[first], c[first]], ids[r[first]], other_ids[a + c[first]]))
            pair, s, src, dst = (np.concatenate(x) for x in zip(*parts))
            kept = _first(np.ones(len(names) * len(others), np.int64), pair, -s, src, dst)
            pair, s, src, dst = pair[kept], s[kept], src[kept], dst[kept]
            if k is not None:
                kept = _first(np.full(len(names), k), pair // len(others), -s, pair % len(others))
                pair, s, src, dst = pair[kept], s[kept], src[kept], dst[kept]
            found.append((names[pair // len(others)], others[pair % len(others)], s, src, dst))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, object)] * 2 + [np.empty(0)] + [np.empty(0, np.int64)] * 2
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c.astype(object) if t == pa.string() else c, t) for c, t in zip(cols, kinds)], names=["grp", "other", "score", "src", "dst"])

    return run


def best_pairs(left: DataFrame, right: DataFrame, *, key: str = "id", vec: str = "vec", group: str = "grp", k: int | None = None, digits: int = 9) -> DataFrame:
    """(grp, other, score, src, dst): the most similar pair of vectors between every two groups.

    With ``k``, a group's pairs outside its ``k`` best others may be left out; all within them are there.
    """
    t, q = _grid(_slim(right, group, key, vec), _slim(left, group, key, vec), "id", "id")
    found = t.groupBy("cell").cogroup(q.groupBy("cell")).applyInArrow(_pair_best(k, digits), "grp string, other string, score double, src long, dst long")
    order = F.struct(F.col("score"), -F.col("src"), -F.col("dst"))
    return found.groupBy("grp", "other").agg(F.max_by(F.struct("score", "src", "dst"), order).alias("b")).select("grp", "other", "b.score", "b.src", "b.dst")
