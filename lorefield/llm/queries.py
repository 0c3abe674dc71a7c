"""The pN_ queries: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.llm import cooccur, encoding, leakage, near_dup, pii, quality, splitting, term_freq
from lorefield.llm.cleaning import clean_sql, clean_tag, clean_value
from lorefield.session import read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    words = pii.lexicon_of(read_table(spark, sf, "name_lexicon"))
    found = pii.find_items(read_table(spark, sf, "messages"), "message_id", "content", words, "message")
    found = found.unionByName(pii.find_items(read_table(spark, sf, "chunk_results"), "chunk_id", "text", words, "chunk"))
    return found.select("src", "rec_id", "kind", "start_pos")


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    words = pii.lexicon_of(read_table(spark, sf, "name_lexicon"))
    one = pii.redacted(read_table(spark, sf, "messages"), "message_id", "content", words, "message")
    return one.unionByName(pii.redacted(read_table(spark, sf, "chunk_results"), "chunk_id", "text", words, "chunk"))


def _items(rows: DataFrame) -> DataFrame:
    """(basket, item): the clean tag and value of each contribution, joined by ``=``."""
    tag, value = clean_tag(F.col("tag")), clean_value(F.col("value"))
    rows = rows.select(F.col("chunk_id").alias("basket"), tag.alias("t"), value.alias("v")).filter("t <> '' and v <> ''")
    return rows.select("basket", F.concat_ws("=", "t", "v").alias("item"))


def _in_steps(spark: SparkSession, sf: str, late: str) -> cooccur.PairTable:
    """The pair table of an earlier state, without the contributions of one origin, and then of the baskets these change."""
    rows = read_table(spark, sf, "tag_values")
    own = F.lower(F.coalesce("origin", F.lit(""))) == late
    table = cooccur.PairTable(spark).update(_items(rows.filter(~own)))
    changed = rows.filter(own & F.col("chunk_id").isNotNull()).select("chunk_id").distinct()
    return table.update(_items(rows.join(changed, "chunk_id", "left_semi")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _in_steps(spark, sf, "tmp").associated().select("item_a", "item_b")


def p2_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same result with a detour: the late contributions are taken back and given again."""
    rows = read_table(spark, sf, "tag_values")
    own = F.lower(F.coalesce("origin", F.lit(""))) == "tmp"
    changed = rows.filter(own & F.col("chunk_id").isNotNull()).select("chunk_id").distinct()
    named = changed.select(F.col("chunk_id").alias("basket"), F.lit("").alias("item"))
    table = _in_steps(spark, sf, "tmp")
    table = table.update(_items(rows.filter(~own).join(changed, "chunk_id", "left_semi")).unionByName(named))
    table = table.update(_items(rows.join(changed, "chunk_id", "left_semi")))
    return table.associated().select("item_a", "item_b", "n_a", "n_b", "n_ab")


def _near(spark: SparkSession, sf: str) -> dict:
    return {"chunk": (read_table(spark, sf, "chunk_results"), "chunk_id", "text"), "entry": (read_table(spark, sf, "search_entries"), "entry_id", "text")}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = _near(spark, sf)
    links, members, names = near_dup.near_duplicates(tables)
    return near_dup.expand(links, members, near_dup.prepare(tables), names)


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    links, members, names = near_dup.near_duplicates(_near(spark, sf), threshold=0.6)
    return near_dup.classes(links, members, names)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = splitting.piece_ranges(read_table(spark, sf, "chunk_results"), "chunk_id", "chunk_range", "text", "chunk")
    return chunks.unionByName(splitting.piece_ranges(read_table(spark, sf, "search_entries"), "entry_id", "chunk_range", "text", "entry"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = splitting.pieces(read_table(spark, sf, "chunk_results"), "chunk_id", "chunk_range", "text", "chunk")
    return chunks.unionByName(splitting.pieces(read_table(spark, sf, "search_entries"), "entry_id", "chunk_range", "text", "entry"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    values, events = read_table(spark, sf, "tag_values"), read_table(spark, sf, "tag_events")
    keys = ("tag", "value", "tvid", "origin")
    return term_freq.term_counts(
        [
            term_freq.TermField("tag", values, "chunk_id", clean_tag(F.col("tag")), keys, (1, 5), F.col("n")),
            term_freq.TermField("value", values, "chunk_id", clean_value(F.col("value")), keys, (1, 10), F.col("n")),
            term_freq.TermField("event_tag", events, "event_id", clean_tag(F.col("tag")), ("tag",), (1, 10)),
        ]
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).filter("mark is not null").select("field", "term", "mark")


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_table(read_table(spark, sf, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))
    return found.filter(F.col("exact") >= leakage.SPAN).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every leak with the longest exact and substitution-tolerant passage, from eight words on."""
    found = leakage.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))
    return found.filter(F.col("tolerant") >= leakage.SPAN)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_kinds(read_table(spark, sf, "documents"), "doc_id", "text").filter("kind <> 'prose'")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(read_table(spark, sf, "documents"), "doc_id", "text")


QUERIES = (p1_found, p1_redacted, p2_found, p2_incremental, p3_found, p3_classes, p4_found, p4_pieces, p5_found, p5_counts, p6_ids, p7_found, p7_passages, p8_found, p8_statistics)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _pair_sql(columns: str) -> str:
    return f"""
    WITH items AS (
      SELECT DISTINCT chunk_id, t || '=' || v AS item FROM (
        SELECT chunk_id, {clean_sql("tag", True)} AS t, {clean_sql("value")} AS v FROM tag_values WHERE chunk_id IS NOT NULL)
      WHERE t <> '' AND v <> ''),
    total AS (SELECT count(DISTINCT chunk_id) AS total FROM items),
    m AS (SELECT item, count(*) AS n FROM items GROUP BY item),
    p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.chunk_id = b.chunk_id AND a.item < b.item GROUP BY ALL)
    SELECT {columns} FROM (
      SELECT item_a, item_b, ma.n AS n_a, mb.n AS n_b, n_ab, total FROM p
      JOIN m ma ON ma.item = item_a JOIN m mb ON mb.item = item_b CROSS JOIN total)
    WHERE n_ab >= 5 AND n_ab * 2000 >= total AND n_ab * total >= 4 * n_a * n_b
    """


def _term_sql() -> str:
    def part(field: str, table: str, record: str, term: str, keys: str, n: str, den: int) -> str:
        return f"""
        SELECT '{field}' AS field, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT record) AS records,
          CASE WHEN count(DISTINCT record) < 3 THEN 'rare'
               WHEN count(DISTINCT record) * {den} > (SELECT count(DISTINCT {record}) FROM {table}) THEN 'common' END AS mark
        FROM (SELECT DISTINCT {record} AS record, {term} AS term, {keys}, {n} AS n FROM {table} WHERE {record} IS NOT NULL)
        WHERE term <> '' GROUP BY term"""

    keys = "tag, value, tvid, origin"
    return " UNION ALL ".join(
        [
            part("tag", "tag_values", "chunk_id", clean_sql("tag", True), keys, "coalesce(n, 1)", 5),
            part("value", "tag_values", "chunk_id", clean_sql("value"), keys, "coalesce(n, 1)", 10),
            part("event_tag", "tag_events", "event_id", clean_sql("tag", True), "tag", "1", 10),
        ]
    )


WORD_LIST = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
LEAK_SQL = f"""
    WITH w AS (SELECT DISTINCT doc_id, {WORD_LIST} AS k FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    v AS (SELECT DISTINCT item_id, {WORD_LIST} AS k FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
    d AS (SELECT DISTINCT doc_id, array_to_string(k[i:i + 7], ' ') AS g FROM (SELECT doc_id, k, unnest(range(1, len(k) - 6)) AS i FROM w WHERE len(k) >= 8)),
    t AS (SELECT DISTINCT item_id, array_to_string(k[i:i + 7], ' ') AS g FROM (SELECT item_id, k, unnest(range(1, len(k) - 6)) AS i FROM v WHERE len(k) >= 8))
    SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (g)"""
NEAR_SQL = f"""
    WITH x AS (SELECT 'chunk' AS src, chunk_id AS id, text FROM chunk_results WHERE text IS NOT NULL UNION SELECT 'entry', entry_id, text FROM search_entries WHERE text IS NOT NULL),
    w AS (SELECT src, id, {WORD_LIST} AS k FROM x WHERE id IS NOT NULL),
    g AS (SELECT DISTINCT src, id, array_to_string(k[i:i + 2], ' ') AS triple FROM (SELECT src, id, k, unnest(range(1, len(k) - 1)) AS i FROM w WHERE len(k) >= 20)),
    n AS (SELECT src, id, count(*) AS n FROM g GROUP BY ALL),
    p AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.src = b.src AND a.triple = b.triple AND a.id < b.id GROUP BY ALL)
    SELECT p.src, id_a, id_b FROM p JOIN n x ON x.src = p.src AND x.id = id_a JOIN n y ON y.src = p.src AND y.id = id_b WHERE c * 10 >= 6 * (x.n + y.n - c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": NEAR_SQL,
        "p7_found": LEAK_SQL,
        "p2_found": _pair_sql("item_a, item_b"),
        "p2_incremental": _pair_sql("item_a, item_b, n_a, n_b, n_ab"),
        "p5_found": f"SELECT field, term, mark FROM ({_term_sql()}) WHERE mark IS NOT NULL",
        "p5_counts": _term_sql(),
    }
