"""Recall: several scored passes over the chunks, merged by maximum, filtered and allocated.

Inputs are a handful of texts or vectors, which become literals; each pass is one scan that keeps the
best candidates of every input. The tag pass keeps values and takes all chunks that carry them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefield.functions import text as T

AXES = ("vector", "trigram", "tag")


def hits_per_input(scored: DataFrame, keep: int) -> DataFrame:
    """(input, chunk_id, score, rank): the ``keep`` best chunks of every input of ``scored(input, chunk_id, score)``."""
    best = scored.groupBy("input", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("input").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def merged(hits: DataFrame) -> DataFrame:
    """(chunk_id, score): the maximum over the inputs. Each input was cut by itself, so a weak one keeps its own."""
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score"))


def _by_input(rows: DataFrame, scores: Column, *keep: str) -> DataFrame:
    """(keep, input, score) of an array of one score per input; scores of 0 are no hits."""
    numbered = F.transform(scores, lambda s, i: F.struct(i.alias("input"), F.round(s, 6).alias("score")))
    return rows.select(*keep, F.explode(F.filter(numbered, lambda r: r["score"] > 0)).alias("r")).select(*keep, "r.input", "r.score")


def _similar(text: Column, inputs: list[str], floor: float) -> Column:
    """One trigram Jaccard per input; under the coverage floor it is 0."""
    return T.let(T.gram_codes(F.lower(text)), lambda g: F.array(*[T.jaccard_with_floor(T.literal_codes(q.lower()), g, floor) for q in inputs]))


def trigram_hits(chunks: DataFrame, inputs: list[str], keep: int, floor: float = 0.1) -> DataFrame:
    """(input, chunk_id, score, rank): the ``keep`` best chunks per input by trigram Jaccard."""
    return hits_per_input(_by_input(chunks.filter("text is not null"), _similar(F.col("text"), inputs, floor), "chunk_id"), keep)


def trigram_pass(chunks: DataFrame, inputs: list[str], keep: int, floor: float = 0.1) -> DataFrame:
    """(chunk_id, score): the hits of all inputs, by their maximum."""
    return merged(trigram_hits(chunks, inputs, keep, floor))


def tag_pass(tags: DataFrame, inputs: list[str], keep: int, discussed: DataFrame | None = None, floor: float = 0.1) -> DataFrame:
    """(chunk_id, score): trigram Jaccard of the inputs with tag values, for every chunk that carries one of the best.

    Distinct pairs are scored and cut to the ``keep`` best per input; the chunks that carry them are all
    taken. Pairs in ``discussed`` (see ``exclude_discussed``) are left out before the cut.
    """
    pairs = tags.filter("tag is not null and value <> ''").select("tag", "value").distinct()
    if discussed is not None:
        exact, whole = _discussed(discussed)
        pairs = pairs.join(exact, ["tag", "value"], "left_anti").join(whole, "tag", "left_anti")
    scored = _by_input(pairs, _similar(F.col("value"), inputs, floor), "tag", "value")
    w = Window.partitionBy("input").orderBy(F.desc("score"), "tag", "value")
    hits = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).groupBy("tag", "value").agg(F.max("score").alias("score"))
    return tags.select("chunk_id", "tag", "value").join(hits, ["tag", "value"]).filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("score").alias("score"))


def _discussed(discussed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that were discussed, and tags of which every value was."""
    return discussed.filter("value is not null").select("tag", "value").distinct(), discussed.filter("value is null").select("tag").distinct()


def merge_axes(passes: dict[str, DataFrame]) -> DataFrame:
    """(chunk_id, vector, trigram, tag, score): the maximum per axis, 0 where a pass missed the chunk."""
    rows = None
    for axis, df in passes.items():
        one = df.select("chunk_id", F.lit(axis).alias("axis"), "score")
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("chunk_id").agg(*[F.coalesce(F.max(F.when(F.col("axis") == a, F.col("score"))), F.lit(0.0)).alias(a) for a in AXES])
    return wide.withColumn("score", F.greatest(*AXES))


def exclude_discussed(cands: DataFrame, tags: DataFrame, discussed: DataFrame, keep_tagless: bool = True) -> DataFrame:
    """Candidates that still have a tag that wasn't discussed; tagless ones only if allowed.

    ``discussed`` holds (tag, value); a null value stands for every value of the tag.
    """
    own = tags.filter("tag is not null and chunk_id is not null").select("chunk_id", "tag", F.coalesce("value", F.lit("")).alias("value")).join(cands.select("chunk_id"), "chunk_id", "left_semi").distinct()
    exact, whole = _discussed(discussed)
    left = own.join(exact, ["tag", "value"], "left_anti").join(whole, "tag", "left_anti")
    had, has = own.select("chunk_id").distinct(), left.select("chunk_id").distinct()
    kept = cands.join(has, "chunk_id", "left_semi")
    return kept.unionByName(cands.join(had, "chunk_id", "left_anti")) if keep_tagless else kept


def cool_down(cands: DataFrame, surfaced: DataFrame, now, window_seconds: int) -> DataFrame:
    """Candidates that weren't surfaced within the window."""
    recent = surfaced.filter(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts") < window_seconds)
    return cands.join(recent.select("chunk_id").distinct(), "chunk_id", "left_anti")


def description_similarity(definitions: DataFrame, inputs: list[str]) -> DataFrame:
    """(input, tag, score): trigram Jaccard of every input with the tags' descriptions, without a floor."""
    scores = T.let(T.gram_codes(F.lower("description")), lambda g: F.array(*[T.jaccard(T.literal_codes(q.lower()), g) for q in inputs]))
    return _by_input(definitions, scores, "tag")


def connections(vector_defs: DataFrame, trigram_defs: DataFrame, vector_hits: DataFrame, trigram_hits: DataFrame, tags: DataFrame, k: int, evidence: int = 10, admitted: int = 40) -> DataFrame:
    """(tag, vector_ed, trigram_ed, vector_ec, trigram_ec, score, chunks): the ``k`` tags nearest to the inputs.

    Two axes compare the inputs with the tags' definitions ``(input, tag, score)``, two let the inputs' best chunks
    ``(input, chunk_id, score, rank)`` vote for the tags they carry. An axis is the maximum over the inputs, the score that
    over the axes; ties go by tag. Per input a tag admits the first ``admitted`` of its chunks, vector hits before
    trigram hits; the ``evidence`` smallest ids of all are shown.
    """
    own = tags.filter("tag is not null and chunk_id is not null").select("chunk_id", "tag").distinct()
    votes = None
    for number, (axis, hits) in enumerate((("vector_ec", vector_hits), ("trigram_ec", trigram_hits))):
        one = hits.select("input", "chunk_id", "score", F.lit(axis).alias("axis"), (F.col("rank") + number * 1_000_000).alias("at"))
        votes = one if votes is None else votes.unionByName(one)
    votes = votes.filter("score > 0").join(own, "chunk_id")
    scores = votes.select("tag", "axis", "score")
    for axis, rows in (("vector_ed", vector_defs), ("trigram_ed", trigram_defs)):
        scores = scores.unionByName(rows.select("tag", F.lit(axis).alias("axis"), "score"))
    names = ("vector_ed", "trigram_ed", "vector_ec", "trigram_ec")
    wide = scores.groupBy("tag").agg(*[F.coalesce(F.max(F.when(F.col("axis") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in names]).withColumn("score", F.greatest(*names))
    best = wide.filter("score > 0").orderBy(F.desc("score"), "tag").limit(k)
    first = votes.groupBy("input", "tag", "chunk_id").agg(F.min("at").alias("at"))
    order = F.row_number().over(Window.partitionBy("input", "tag").orderBy("at"))
    shown = first.withColumn("rn", order).filter(F.col("rn") <= admitted).select("tag", "chunk_id").distinct()
    # at most ``admitted`` ids per input
    shown = shown.groupBy("tag").agg(F.slice(F.array_sort(F.collect_list("chunk_id")), 1, evidence).alias("ids"))
    out = best.join(shown, "tag", "left")
    return out.select("tag", *names, "score", F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("chunks"))


CELLS = (("main", "meaning"), ("main", "tags"), ("conversation", "meaning"), ("conversation", "tags"))


def allocate(cands: pd.DataFrame, per_cell: int = 3, k: int = 12, per_file: int = 2) -> pd.DataFrame:
    """Fill the 2x2 grid of source and axis from candidates (key, source, file_id, meaning, tags).

    A candidate's home is the axis it scores higher on (meaning on a tie). Every cell first takes up to
    ``per_cell`` of its home candidates, then the cells take turns with their next best until the grid is
    full. Within a cell a file gives at most ``per_file``. Order is by score, then key.
    """
    rows = [r for r in cands.to_dict("records")]
    queue = {c: sorted((r for r in rows if r["source"] == c[0] and r[c[1]] > 0), key=lambda r, c=c: (-r[c[1]], r["key"])) for c in CELLS}
    home = {r["key"]: (r["source"], "meaning" if r["meaning"] >= r["tags"] else "tags") for r in rows}
    used: set = set()
    files: dict = {}
    out: list[dict] = []

    def take(cell, only_home: bool) -> bool:
        for r in queue[cell]:
            free = r["key"] not in used and files.get((cell, r["file_id"]), 0) < per_file
            if free and (not only_home or home[r["key"]] == cell):
                used.add(r["key"])
                files[cell, r["file_id"]] = files.get((cell, r["file_id"]), 0) + 1
                out.append({"key": r["key"], "cell": "-".join(cell), "score": max(r["meaning"], r["tags"])})
                return True
        return False

    for cell in CELLS:
        for _ in range(per_cell):
            if not take(cell, True):
                break
    goal, moved = per_cell * len(CELLS), True
    while len(out) < goal and moved:
        moved = False
        for cell in CELLS:
            if len(out) < goal and take(cell, False):
                moved = True
    out.sort(key=lambda r: (-r["score"], r["key"]))
    return pd.DataFrame(out[:k], columns=["key", "cell", "score"])


def allocate_per_request(cands: DataFrame, per_cell: int = 3, k: int = 12) -> DataFrame:
    """(request, key, cell, score) per request.

    The filling is sequential, so it runs in Python, on groups cut to what can matter: the best
    ``4 * per_cell`` per request, source, axis and file rank.
    """
    goal = per_cell * len(CELLS)
    parts = []
    for axis in ("meaning", "tags"):
        per_file = Window.partitionBy("request", "source", "file_id").orderBy(F.desc(axis), "key")
        per_source = Window.partitionBy("request", "source").orderBy(F.desc(axis), "key")
        # a cell takes at most two of a file and at most the goal in all, plus those other cells took before
        best = cands.filter(F.col(axis) > 0).withColumn("f", F.row_number().over(per_file)).filter(F.col("f") <= goal + 2).withColumn("s", F.row_number().over(per_source)).filter(F.col("s") <= goal * (goal + 2))
        parts.append(best.select("request", "key", "source", "file_id", "meaning", "tags"))
    few = parts[0].unionByName(parts[1]).distinct()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = allocate(pdf, per_cell, k)
        got.insert(0, "request", key[0])
        return got

    return few.groupBy("request").applyInPandas(run, "request long, key long, cell string, score double")
