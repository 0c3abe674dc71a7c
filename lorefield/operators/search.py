"""Full-text scores over trigrams and words, and the search modes that combine them.

A query is short, so its trigrams and words are literals; scoring is then one pass over the chunks
without a join. The only statistic a score needs from the corpus is how many chunks hold each of the
query's grams, which is a single aggregation over the same scan.

Definitions, fixed here: *coverage* is the share of the query's trigrams in the chunk, for chunks
that hold them all; *overlap* their number; *density* the share of the chunk's words that are query words;
*bm25* the published formula over trigrams with ``k1=1.2`` and ``b=0.75``; *fuzzy* the trigram Jaccard.
Scores are rounded to six digits, and ties are broken by the chunk's id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefield.functions import text as T

K1, B = 1.2, 0.75


def query_grams(query: str) -> list[str]:
    q = query.lower()
    return list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2))) if len(q) >= 3 else ([q] if q else [])


def query_words(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"[^\W]+", query.lower())))


def gram_counts(chunks: DataFrame, query: str, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """(gram, df, total): in how many chunks each trigram of the query occurs; absent grams count 0.

    Repeated rows are removed by key and flags, so no text is shuffled.
    """
    grams = query_grams(query)
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = chunks.select(key, *[F.contains(body, F.lit(g)).alias(f"g{i}") for i, g in enumerate(grams)]).distinct()
    row = flags.agg(F.count("*").alias("total"), *[F.sum(F.col(f"g{i}").cast("long")).alias(f"g{i}") for i in range(len(grams))])
    cells = F.array(*[F.struct(F.lit(g).alias("gram"), F.coalesce(F.col(f"g{i}"), F.lit(0)).alias("df")) for i, g in enumerate(grams)])
    return row.select("total", F.explode(cells).alias("c")).select("c.gram", "c.df", "total")


def discriminating(chunks: DataFrame, query: str, share: float = 0.5, text: str = "text") -> list[str]:
    """The query's grams in at most ``share`` of the chunks; all of them if none is.

    As many rows come to the driver as the query has grams.
    """
    rows = {r["gram"]: (r["df"], r["total"]) for r in gram_counts(chunks, query, text).collect()}
    kept = [g for g in query_grams(query) if rows[g][0] <= share * rows[g][1]]
    return kept or query_grams(query)


def _hits(text: Column, grams: list[str]) -> Column:
    body = F.lower(text)
    return sum((F.contains(body, F.lit(g)).cast("int") for g in grams), F.lit(0))


def coverage(text: Column, grams: list[str]) -> Column:
    return F.round(_hits(text, grams) / F.lit(max(1, len(grams))), 6)


def overlap(text: Column, grams: list[str]) -> Column:
    return _hits(text, grams).cast("double")


def density(text: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(0.0)

    def share(toks: Column) -> Column:
        hit = F.size(F.filter(toks, lambda w: w.isin(*words)))
        return F.round(F.when(F.size(toks) > 0, hit / F.size(toks)).otherwise(F.lit(0.0)), 6)

    return T.let(T.tokens(text), share)


def _occurrences(body: Column, gram: str) -> Column:
    """Occurrences of a gram in a lower-cased text, overlapping ones included."""
    if gram and gram[0] != gram[-1]:  # it can't overlap itself, so removing it counts it
        return (F.length(body) - F.length(F.replace(body, F.lit(gram), F.lit("")))) / len(gram)
    return F.size(F.split(F.regexp_replace(body, "(?=" + _quote(gram) + ")", "\x00"), "\x00")) - 1


def _quote(gram: str) -> str:
    import re

    return re.escape(gram)


def statistics(chunks: DataFrame, query: str, text: str = "text", key: str = "chunk_id") -> tuple[dict[str, int], int, float]:
    """(document frequency of each of the query's grams, chunks, mean number of grams), by one pass that ends in one row."""
    grams = query_grams(query)
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    size = F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))) - 2, F.lit(0))
    flags = chunks.select(key, size.alias("n"), *[F.contains(body, F.lit(g)).alias(f"g{i}") for i, g in enumerate(grams)]).distinct()
    row = flags.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *[F.sum(F.col(f"g{i}").cast("long")).alias(f"g{i}") for i in range(len(grams))]).first()
    return {g: row[f"g{i}"] or 0 for i, g in enumerate(grams)}, row["total"], row["mean"] or 1.0


def _kept_grams(df: dict[str, int], total: int, share: float) -> list[str]:
    return [g for g, n in df.items() if n <= share * total] or list(df)


def bm25_score(body: Column, df: dict[str, int], total: int, mean: float) -> Column:
    """BM25 of a lower-cased text over the query's trigrams."""
    size = F.greatest(F.length(body) - 2, F.lit(0))
    score = F.lit(0.0)
    for g, n in df.items():
        idf = math.log(1 + (total - n + 0.5) / (n + 0.5))
        score = score + idf * T.let(_occurrences(body, g), lambda tf: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / float(mean))))
    return F.round(score, 6)


def bm25(chunks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Hits with their ``score``: BM25 over the query's trigrams."""
    stats = statistics(chunks, query, text)
    return T.hits(chunks, T.let(F.lower(text), lambda body: bm25_score(body, *stats)), *_kept(chunks))


def _kept(chunks: DataFrame) -> list[str]:
    """Columns that go on with a hit: all but the texts."""
    return [c for c in chunks.columns if c not in ("text", "chunk_range", "score")]


def ranked(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The ``k`` best hits (TakeOrderedAndProject), ties by key; repeated rows count once."""
    return scored.distinct().orderBy(F.desc("score"), F.asc(key)).limit(k)


def by_strategy(chunks: DataFrame, query: str, strategy: str, text: str = "text", share: float = 0.5) -> DataFrame:
    """The hits of one strategy with their score, without their texts."""
    t, keep = F.col(text), _kept(chunks)
    if strategy == "density":
        return T.hits(chunks, density(t, query_words(query)), *keep)
    if strategy == "bm25":
        return bm25(chunks, query, text)
    if strategy == "fuzzy":
        return T.hits(chunks, F.round(T.jaccard(T.literal_codes(query.lower()), T.gram_codes(F.lower(t))), 6), *keep)
    grams = discriminating(chunks, query, share, text)
    if strategy == "overlap":
        return T.hits(chunks, overlap(t, grams), *keep)
    return T.hits(chunks, coverage(t, grams), *keep).filter("score >= 1")


def escalating(chunks: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """Coverage hits, or density hits if there are none: one plan, decided by an anti-join on a constant."""
    cov = ranked(by_strategy(chunks, query, "coverage", text), k).withColumn("strategy", F.lit("coverage"))
    den = ranked(by_strategy(chunks, query, "density", text), k).withColumn("strategy", F.lit("density"))
    some = cov.select(F.lit("density").alias("strategy")).limit(1)
    return cov.unionByName(den.join(some, "strategy", "left_anti"))


def multi(chunks: DataFrame, query: str, k: int, text: str = "text", share: float = 0.5) -> DataFrame:
    """(chunk_id, score, strategy): the best ``k`` of each strategy, the maximum per chunk, then the best ``k``.

    Two passes over the texts: one for the statistics, one that gives a chunk all four scores as rows. Each strategy
    is cut within the tasks before anything is shuffled.
    """
    df, total, mean = statistics(chunks, query, text)
    grams, words = _kept_grams(df, total, share), query_words(query)

    def scores(body: Column) -> Column:
        found = _hits(body, grams)
        whole = F.round(found / F.lit(max(1, len(grams))), 6)
        cells = (("bm25", bm25_score(body, df, total, mean)), ("coverage", F.when(whole >= 1, whole)), ("density", density(body, words)), ("overlap", found.cast("double")))
        return F.array(*[F.struct(F.lit(s).alias("strategy"), c.cast("double").alias("score")) for s, c in cells])

    rows = chunks.select("chunk_id", F.explode(F.filter(T.let(F.lower(text), scores), lambda c: c["score"] > 0)).alias("c"))
    w = Window.partitionBy("strategy").orderBy(F.desc("score"), "chunk_id")
    best = rows.select("chunk_id", "c.strategy", "c.score").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    merged = best.groupBy("chunk_id").agg(F.max("score").alias("score"), F.max_by("strategy", F.struct("score", "strategy")).alias("first"), F.count("*").alias("n"))
    named = merged.select("chunk_id", "score", F.when(F.col("n") > 1, "multi").otherwise(F.col("first")).alias("strategy"))
    return ranked(named, k)


def merge_hybrid(fts: DataFrame, vec: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Full outer merge: a missing side scores 0, the sum is the score."""
    f = fts.select(key, F.col("score").alias("fts_score"))
    v = vec.select(key, F.col("score").alias("vec_score"))
    out = f.join(v, key, "full_outer").fillna(0.0, ["fts_score", "vec_score"])
    return out.withColumn("score", F.round(F.col("fts_score") + F.col("vec_score"), 6))


def intersect_hybrid(fts: DataFrame, vec: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Inner merge: only chunks that both sides found, with the sum of the scores."""
    f = fts.select(key, F.col("score").alias("fts_score"))
    v = vec.select(key, F.col("score").alias("vec_score"))
    return f.join(v, key).withColumn("score", F.round(F.col("fts_score") + F.col("vec_score"), 6))


def min_span(text: Column, words: list[str]) -> Column:
    """Fewest consecutive words of the text that hold all query words; null if they don't.

    Folding over the words keeps the last place of every query word; the span at a word is the
    distance to the earliest of these places.
    """
    toks = T.tokens(text)
    names = [f"w{i}" for i in range(len(words))]
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"), *[F.lit(None).cast("int").alias(n) for n in names])

    def step(s: Column, w: Column) -> Column:
        at = s["at"] + 1
        last = [F.when(w == q, at).otherwise(s[n]) for q, n in zip(words, names)]
        first = F.least(*last) if len(last) > 1 else last[0]
        whole = ~F.array_contains(F.transform(F.array(*last), lambda x: x.isNull()), True)
        span = F.when(whole, at - first + 1)
        return F.struct(at.alias("at"), F.least(s["best"], span).alias("best"), *[x.alias(n) for x, n in zip(last, names)])

    return F.aggregate(toks, zero, step, lambda s: s["best"])


def grouped(results: DataFrame, files: DataFrame) -> DataFrame:
    """Files by their best chunk, each with its chunks by score."""
    hit = results.join(files.select("path", "file_id").distinct(), "path")
    agg = hit.groupBy("path").agg(
        F.max("score").alias("best"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "chunk_id"))).alias("rows"),
    )
    ids = F.array_join(F.transform("rows", lambda r: r["chunk_id"].cast("string")), ",")
    return agg.select("path", "best", "n", ids.alias("chunk_ids"))


def recent_rank(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The latest ``n`` rows per key."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
