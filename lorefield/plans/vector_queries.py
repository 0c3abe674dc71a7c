"""Vector search, hot correlations, suggestions and hybrid queries over the embeddings.

The first two vectors of each label play the definitions of the tag ``topic-<label>`` in two files;
all vectors are chunk vectors. Searches take as queries the vectors whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorefield.functions import vectors as V
from lorefield.operators import search as S
from lorefield.operators import vector_search as X
from lorefield.plans.common import Registry, chunks, r6, vecs, vector_ids
from lorefield.operators.hot import HotTable
from lorefield.session import read_table, scratch_path
from lorefield.sources import store

R = Registry()
E = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, 'topic-' || label AS tag FROM embeddings)"
DEFS = f"(SELECT *, row_number() OVER (PARTITION BY tag ORDER BY id) AS file_id FROM {E} QUALIFY row_number() OVER (PARTITION BY tag ORDER BY id) <= 2)"
COS = "round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 6)"


def _defs(spark, sf):
    w = Window.partitionBy("tag").orderBy("id")
    return vecs(spark, sf).withColumn("file_id", F.row_number().over(w)).filter("file_id <= 2")


@R.add(f"""SELECT CAST(a.id AS VARCHAR) AS grp, b.id, {COS} AS score FROM {E} a, {E} b WHERE a.id % 50 = 0 AND a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) DESC, b.id) <= 20""")
def q077_multi_query_vectors(spark, sf):
    v = vecs(spark, sf)
    q = v.filter("id % 50 = 0").select(F.col("id").cast("string").alias("grp"), F.col("id").alias("qid"), "vec")
    return X.top_k(v, q, 20, skip_same=True).select("grp", "id", r6(F.col("score")).alias("score"))


@R.add(f"""SELECT b.id, {COS} AS score FROM {E} a, {E} b WHERE a.id = 0 ORDER BY score DESC, b.id LIMIT 20""")
def q076_vector_search(spark, sf):
    """One query vector: it is a literal of one row, joined on a constant, and top-k ends the plan."""
    v = vecs(spark, sf)
    q = v.filter("id = 0").select(F.lit(1).alias("k"), F.col("vec").alias("q"))
    scored = v.withColumn("k", F.lit(1)).join(F.broadcast(q), "k").select("id", r6(V.cosine(F.col("q"), F.col("vec"))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(20)


@R.add(f"""SELECT tag AS grp, id, score FROM (SELECT a.tag, b.id, max({COS}) AS score FROM {DEFS} a, {E} b GROUP BY a.tag, b.id) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) <= 20""")
def q184_hot_correlations(spark, sf):
    q = _defs(spark, sf).select(F.col("tag").alias("grp"), F.col("id").alias("qid"), "vec")
    return X.top_k(vecs(spark, sf), q, 20).select("grp", "id", r6(F.col("score")).alias("score"))


#: Definitions after an edit: the first definition of topic-3 becomes what vector 7 says.
EDITED = f"(SELECT d.tag, d.id, d.file_id, CASE WHEN d.tag = 'topic-3' AND d.file_id = 1 THEN (SELECT vec FROM {E} WHERE id = 7) ELSE d.vec END AS vec FROM {DEFS} d)"
SWEPT = f"(SELECT tag, id, score FROM (SELECT a.tag, b.id, max({COS}) AS score FROM {EDITED} a, {E} b GROUP BY a.tag, b.id) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) <= 20)"


def _hot(spark, sf):
    """A hot table after two sweeps: without the chunks whose id is divisible by 7, then with them and an edited definition."""
    v, d = vecs(spark, sf), _defs(spark, sf).select("tag", "file_id", "vec")
    other = v.filter("id = 7").select(F.lit("topic-3").alias("tag"), F.lit(1).alias("file_id"), F.col("vec").alias("seventh"))
    edited = d.join(F.broadcast(other), ["tag", "file_id"], "left").select("tag", "file_id", F.coalesce("seventh", "vec").alias("vec"), F.when(F.col("seventh").isNull(), 1).otherwise(2).alias("serial"))
    serial = F.when(F.col("id") % 7 == 0, 2).otherwise(1)
    table = HotTable(spark, k=20, digits=6).sweep(v.filter("id % 7 <> 0").select("id", "vec", F.lit(1).alias("serial")), d.withColumn("serial", F.lit(1)))
    return table.sweep(v.select("id", "vec", serial.alias("serial")), edited), edited


@R.add(f"SELECT tag AS grp, id, score FROM {SWEPT}")
def q184_incremental_sweep(spark, sf):
    """Stored buckets and a bookmark: only changed chunks are scored, and only the edited tag is built anew."""
    return _hot(spark, sf)[0].buckets().select(F.col("tag").alias("grp"), F.col("chunk_id").alias("id"), "score")


@R.add(f"SELECT tag AS grp, id, score FROM {SWEPT} WHERE id % 5 <> 0 AND tag <> 'topic-4'")
def q185_fresh_only(spark, sf):
    """Stored correlations no older than their chunk and their tag's newest definition, after later writes of both."""
    table, defs = _hot(spark, sf)
    v = vecs(spark, sf).select("id", F.when(F.col("id") % 5 == 0, 3).otherwise(1).alias("serial"))
    newer = defs.select("tag", F.when(F.col("tag") == "topic-4", 3).otherwise(F.col("serial")).alias("serial"))
    return table.fresh(v, newer).select(F.col("tag").alias("grp"), F.col("chunk_id").alias("id"), "score")


@R.add("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0")
def q186_since_bookmark(spark, sf):
    """Vectors are written in two stamped batches; the walk since the first gives those of the second."""
    path = scratch_path(spark, "stamped")
    v = vecs(spark, sf).select("id", "vec")
    store.stamp(v, path, 1)
    store.stamp(v.filter("id % 3 = 0"), path, 2)
    return store.since(spark, path, "id long, vec array<float>", 1).select("id")


@R.add(f"""SELECT a.tag AS grp, b.tag AS other, max({COS}) AS score FROM {DEFS} a, {DEFS} b WHERE a.tag <> b.tag GROUP BY ALL""")
def q181_related_tags(spark, sf):
    d = _defs(spark, sf).withColumnRenamed("tag", "grp")
    return X.best_pairs(d, d).filter("grp <> other").select("grp", "other", r6(F.col("score")).alias("score"))


@R.add(f"""SELECT max({COS}) AS score FROM {DEFS} a, {DEFS} b WHERE a.tag = 'topic-1' AND b.tag = 'topic-2'""")
def q182_tag_pair_conflict(spark, sf):
    d = _defs(spark, sf).withColumnRenamed("tag", "grp")
    return X.best_pairs(d.filter("grp = 'topic-1'"), d.filter("grp = 'topic-2'")).select(r6(F.col("score")).alias("score"))


@R.add(f"""SELECT a.tag, a.id AS a_id, b.id AS b_id, {COS} AS score FROM {DEFS} a JOIN {DEFS} b ON a.tag = b.tag AND a.id < b.id""")
def q183_tag_drift(spark, sf):
    a = _defs(spark, sf).select("tag", F.col("id").alias("a_id"), F.col("vec").alias("va"))
    b = _defs(spark, sf).select("tag", F.col("id").alias("b_id"), F.col("vec").alias("vb"))
    return a.join(b, "tag").filter("a_id < b_id").select("tag", "a_id", "b_id", r6(V.cosine(F.col("va"), F.col("vb"))).alias("score"))


@R.add(f"""SELECT CAST(b.id AS VARCHAR) AS chunk, a.tag, max({COS}) AS score FROM {DEFS} a, {E} b WHERE b.id % 50 = 0 GROUP BY b.id, a.tag QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY max({COS}) DESC, a.tag) <= 5""")
def q179_suggest_tags(spark, sf):
    """For the chunks whose id is divisible by 50, the five nearest tags by their best definition."""
    c = vecs(spark, sf).filter("id % 50 = 0").select(F.col("id").cast("string").alias("grp"), "id", "vec")
    d = _defs(spark, sf).select(F.col("tag").alias("grp"), "id", "vec")
    best = X.best_pairs(c, d, k=5, digits=6).select(F.col("grp").alias("chunk"), F.col("other").alias("tag"), r6(F.col("score")).alias("score"))
    w = Window.partitionBy("chunk").orderBy(F.desc("score"), "tag")
    return best.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


@R.add(f"""SELECT b.id, max({COS}) AS score FROM {DEFS} a, {E} b WHERE a.tag = 'topic-3' GROUP BY b.id ORDER BY score DESC, b.id LIMIT 15""")
def q180_chunks_for_tag(spark, sf):
    q = _defs(spark, sf).filter("tag = 'topic-3'").select(F.col("tag").alias("grp"), F.col("id").alias("qid"), "vec")
    return X.top_k(vecs(spark, sf), q, 15).select("id", r6(F.col("score")).alias("score"))


@R.add(f"""SELECT tag, n, round(list_sum(list_transform(s, lambda x: x * x)), 4) AS energy FROM (SELECT tag, list(s ORDER BY dim) AS s, max(n) AS n FROM (SELECT tag, dim, sum(vec[dim]) AS s, count(*) AS n FROM (SELECT tag, vec, unnest(range(1, 65)) AS dim FROM {E}) GROUP BY tag, dim) GROUP BY tag)""")
def q114_centroids(spark, sf):
    """Sum and count per tag; ``energy`` is the squared norm of the sum."""
    c = V.centroid_sum(vecs(spark, sf), "tag", "vec")
    return c.select("tag", F.col("count").alias("n"), F.round(V.dot(F.col("sum"), F.col("sum")), 4).alias("energy"))


@R.add(f"""WITH c AS (SELECT tag, list(s ORDER BY dim) AS vec FROM (SELECT tag, dim, sum(vec[dim]) AS s FROM (SELECT tag, vec, unnest(range(1, 65)) AS dim FROM {E}) GROUP BY tag, dim) GROUP BY tag),
    near AS (SELECT b.tag FROM {E} a, c b WHERE a.id = 0 ORDER BY {COS} DESC, b.tag LIMIT 3)
    SELECT b.id, {COS} AS score FROM {E} a, {E} b WHERE a.id = 0 AND b.tag IN (SELECT tag FROM near) ORDER BY score DESC, b.id LIMIT 10""")
def q078_centroid_prefilter(spark, sf):
    """Search within the three groups whose centroids are nearest; lossy by design, so it is opt-in."""
    v = vecs(spark, sf)
    q = v.filter("id = 0").select(F.lit(1).alias("k"), F.col("vec").alias("q"))
    c = V.centroid_sum(v, "tag", "vec").withColumn("k", F.lit(1)).join(F.broadcast(q), "k")
    near = c.select("tag", r6(V.cosine(F.col("q"), F.col("sum"))).alias("score")).orderBy(F.desc("score"), "tag").limit(3)
    rows = v.join(near.select("tag"), "tag", "left_semi").withColumn("k", F.lit(1)).join(F.broadcast(q), "k")
    return rows.select("id", r6(V.cosine(F.col("q"), F.col("vec"))).alias("score")).orderBy(F.desc("score"), "id").limit(10)


FTS = """(SELECT chunk_id, round(len(list_filter(tk, lambda w: w IN ('stale', 'recall', 'pass'))) / len(tk), 6) AS score FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tk FROM (SELECT DISTINCT chunk_id, text FROM chunk_results)) WHERE len(tk) > 0)"""
MAPPED = f"(SELECT c.chunk_id, e.id, e.vec FROM (SELECT DISTINCT chunk_id FROM chunk_results) c JOIN {E} e ON e.id = c.chunk_id % (SELECT count(*) FROM embeddings))"
FTS20 = f"(SELECT * FROM {FTS} WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 40)"
VEC20 = f"(SELECT b.chunk_id, {COS} AS score FROM {E} a, {MAPPED} b WHERE a.id = 0 ORDER BY score DESC, b.chunk_id LIMIT 40)"


def _fts(spark, sf):
    rows = chunks(spark, sf).select("chunk_id", "text")
    return S.ranked(S.by_strategy(rows, "stale recall pass", "density"), 40).select("chunk_id", "score")


def _near(spark, sf):
    """(chunk_id, score): every chunk by its cosine with vector 0."""
    v = vecs(spark, sf)
    q = v.filter("id = 0").select(F.lit(1).alias("k"), F.col("vec").alias("q"))
    scored = v.withColumn("k", F.lit(1)).join(F.broadcast(q), "k").select("id", r6(V.cosine(F.col("q"), F.col("vec"))).alias("score"))  # one row
    return vector_ids(spark, sf).join(scored, "id").select("chunk_id", "score")


def _vec(spark, sf):
    return _near(spark, sf).orderBy(F.desc("score"), "chunk_id").limit(40)


@R.add(f"""SELECT chunk_id, coalesce(f.score, 0) AS fts_score, coalesce(v.score, 0) AS vec_score, round(coalesce(f.score, 0) + coalesce(v.score, 0), 6) AS score FROM {FTS20} f FULL JOIN {VEC20} v USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 20""")
def q060_combined_search(spark, sf):
    return S.ranked(S.merge_hybrid(_fts(spark, sf), _vec(spark, sf)), 20)


@R.add(f"""SELECT chunk_id, f.score AS fts_score, v.score AS vec_score, round(f.score + v.score, 6) AS score FROM (SELECT * FROM {FTS} WHERE score > 0) f JOIN {VEC20} v USING (chunk_id)""")
def q062_split_intersect(spark, sf):
    rows = chunks(spark, sf).select("chunk_id", "text")
    fts = S.by_strategy(rows, "stale recall pass", "density").select("chunk_id", "score").distinct()
    return S.intersect_hybrid(fts, _vec(spark, sf))


@R.add(f"""SELECT DISTINCT chunk_id FROM chunk_results WHERE contains(lower(text), 'digest') AND chunk_id IN (SELECT chunk_id FROM (SELECT b.chunk_id, {COS} AS score FROM {E} a, {MAPPED} b WHERE a.id = 0 ORDER BY score DESC, b.chunk_id LIMIT 200))""")
def q043_about_filter(spark, sf):
    top = _near(spark, sf).orderBy(F.desc("score"), "chunk_id").limit(200)
    return chunks(spark, sf).filter(F.contains(F.lower("text"), F.lit("digest"))).join(top, "chunk_id", "left_semi").select("chunk_id").distinct()


@R.add("SELECT DISTINCT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunk_results WHERE chunk_id IS NOT NULL AND starts_with(path, 'notes/') AND text IS NOT NULL)")
def q036_missing_vectors(spark, sf):
    """A store holds the vectors of one folder's chunks; what a batch has still to embed."""
    from lorefield.plans.more_queries import hashed_embedding

    path, c = scratch_path(spark, "vectors"), chunks(spark, sf)
    store.stamp(hashed_embedding(c.filter("startswith(path, 'notes/') and chunk_id is not null"), "chunk_id", "text"), path, 1)
    return store.missing(c, store.read(spark, path, "chunk_id long, vec array<float>"), "chunk_id")


@R.add(f"""SELECT id, round(least(1.0, greatest(0.0, (score + 1) / 2)), 6) AS score FROM (SELECT b.id, {COS[6:-4]} AS score FROM {E} a, {E} b WHERE a.id = 0)""")
def q151_normalised_cosine(spark, sf):
    v = vecs(spark, sf)
    q = v.filter("id = 0").select(F.lit(1).alias("k"), F.col("vec").alias("q"))
    rows = v.withColumn("k", F.lit(1)).join(F.broadcast(q), "k")
    return rows.select("id", r6(V.normalised(V.cosine(F.col("q"), F.col("vec")))).alias("score"))
