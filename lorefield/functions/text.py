"""Text expressions: trigrams, similarities, ranges, previews and inline tags.

Everything here is a ``Column`` built from built-in functions, so it stays in the JVM and in
whole-stage code generation where Spark allows it. Null text gives null unless a docstring says
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One inline tag: a name, a colon, and the rest of the line as its value.
TAG_PATTERN = r"@([a-zA-Z][\w.-]*):[ \t]*([^\n]*)"


def trim_all(text: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def trigrams(text: Column) -> Column:
    """Distinct 3-character grams; a shorter, non-empty text is its own gram."""
    n = F.length(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))
    return F.when(n >= 3, grams).when(n > 0, F.array(text)).when(n == 0, F.array().cast("array<string>"))


def strip(text: Column | str) -> Column:
    """Strip white space and no-break spaces at both ends; a string names a column."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, "^[\\s\u00a0]+|[\\s\u00a0]+\\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once.

    Catalyst merges projections, so a costly expression that is named in one column and used several
    times in the next is evaluated as often. A lambda variable holds its value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def hits(rows: DataFrame, score: Column, *keep: str, least: float = 0.0) -> DataFrame:
    """``keep`` and ``score`` of the rows that score above ``least``.

    The score goes through a generator, so the test on it cannot be pushed below its computation, which
    would compute it twice.
    """
    return rows.select(*keep, F.explode(F.filter(F.array(score), lambda s: s > least)).alias("score"))


#: All overlapping trigrams, one after the other; never begins within a surrogate pair.
_EVERY_GRAM = r"(?s)(?![\uDC00-\uDFFF])(?=(.{3}))"


def gram_codes(text: Column) -> Column:
    """Distinct trigrams as 64-bit codes.

    One pass of a look-ahead takes all overlapping trigrams, so the work is linear in the text; set
    operations on longs run on hash sets.
    """
    codes = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_EVERY_GRAM), F.lit(1)), lambda g: F.xxhash64(g)))
    n = F.length(text)
    return F.when(n >= 3, codes).when(n > 0, F.array(F.xxhash64(text))).when(n == 0, F.array().cast("array<bigint>"))


def literal_codes(text: str) -> Column:
    """The codes of a literal's trigrams."""
    grams = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))) if len(text) >= 3 else ([text] if text else [])
    codes = [F.xxhash64(F.lit(g)) for g in grams]
    return F.array(*codes) if codes else F.array().cast("array<bigint>")


def tokens(text: Column) -> Column:
    """Lower-cased words (letters, digits, underscore), with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets without repetitions; 0 if both are empty."""

    def score(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        union = F.size(p["a"]) + F.size(p["b"]) - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), score)


def jaccard_with_floor(query: Column, text: Column, floor: float = 0.1) -> Column:
    """Jaccard, but 0 where less than ``floor`` of the query's grams are covered."""

    def score(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        union = F.size(p["a"]) + F.size(p["b"]) - both
        return F.when((both / F.size(p["a"]) < floor) | (union == 0), F.lit(0.0)).otherwise(both / union)

    return let(F.struct(query.alias("a"), text.alias("b")), score)


def fuzzy(query: Column, text: Column) -> Column:
    """Similarity of two strings: trigram Jaccard, or a length ratio on containment of short ones.

    A query of under three characters scores the ratio of byte lengths, at least 0.1, where the text
    contains it, and 0 elsewhere. A text of under three characters that the query contains scores the
    reverse ratio.
    """
    q, t = F.lower(query), F.lower(text)
    ratio = F.octet_length(q) / F.octet_length(t)
    short = F.when(F.contains(t, q), F.greatest(ratio, F.lit(0.1))).otherwise(F.lit(0.0))
    reverse = F.when(F.contains(q, t), F.octet_length(t) / F.octet_length(q)).otherwise(F.lit(0.0))
    full = jaccard(gram_codes(q), gram_codes(t))
    return F.when((F.length(q) == 0) | (F.length(t) == 0), F.lit(0.0)).when(F.length(q) < 3, short).when(F.length(t) < 3, reverse).otherwise(full)


def word_overlap(query: Column, text: Column) -> Column:
    """Share of the query's blank-separated words that the text contains, regardless of case."""
    words = F.filter(F.split(F.lower(query), " "), lambda w: w != "")
    hit = F.filter(words, lambda w: F.contains(F.lower(text), w))
    return F.when(F.size(words) > 0, F.size(hit) / F.size(words)).otherwise(F.lit(0.0))


def range_start(text: Column) -> Column:
    """First line of a ``from-to`` range; null for other forms."""
    return F.regexp_extract(F.when(text.rlike(r"^[0-9]{1,9}-[0-9]{1,9}$"), text), r"^([0-9]+)-", 1).cast("long")


def range_end(text: Column) -> Column:
    """Last line of a ``from-to`` range; null for other forms."""
    return F.regexp_extract(F.when(text.rlike(r"^[0-9]{1,9}-[0-9]{1,9}$"), text), r"-([0-9]+)$", 1).cast("long")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (1-based, inclusive) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n")


def preview(text: Column, query: str, width: int) -> Column:
    """``width`` characters around the first hit of ``query``, cut at blanks, with ellipses.

    Without a hit the window starts at the beginning; a text that fits is returned whole.
    """
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(1), F.when(at > 0, at + len(query) // 2 - width // 2).otherwise(1))
    start = F.greatest(F.lit(1), F.least(start, F.length(text) - width + 1)).cast("int")
    window = F.substring(text, start, F.lit(width))
    head = F.when(start > 1, F.concat(F.lit("..."), F.regexp_replace(window, r"^\S*\s+", ""))).otherwise(window)
    cut = start + width - 1 < F.length(text)
    tail = F.when(cut, F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit("..."))).otherwise(head)
    return F.when(F.length(text) <= width, text).otherwise(tail)


def highlight(text: Column, pattern: str) -> Column:
    """Escape mark-up characters, then put ``<mark>`` around every hit of ``pattern``."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, f"(?i)({pattern})", "<mark>$1</mark>")


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    one = lambda x: F.concat(F.format_string("%.1f", size / x))
    return (
        F.when(size < kb, F.format_string("%d B", size))
        .when(size < mb, F.concat(one(kb), F.lit(" KB")))
        .when(size < gb, F.concat(one(mb), F.lit(" MB")))
        .otherwise(F.concat(one(gb), F.lit(" GB")))
    )


def marks_before(text: Column) -> Column:
    """Number of back-ticks and double quotes before the first ``@name:`` of a line."""
    at = F.regexp_instr(text, F.lit(TAG_PATTERN))
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), at - 1), '[^`"]', ""))


def is_mention(line: Column, in_fence: Column, markdown: Column) -> Column:
    """Whether the first ``@name:`` of a line only mentions a tag.

    That is so behind anything but white space, within an open quotation, and, in markdown, inside a
    fenced block or on a line that a tab or four blanks indent.
    """
    at = F.regexp_instr(line, F.lit(TAG_PATTERN))
    glued = (at > 1) & ~F.substring(line, at - 1, F.lit(1)).isin(" ", "\t")
    quoted = marks_before(line) % 2 == 1
    code = markdown & (in_fence | line.startswith("\t") | line.startswith("    "))
    return glued | quoted | code


def fence_parity(lines: Column) -> Column:
    """For an array of lines, whether each stands inside a fenced block; the fences themselves do."""
    zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("seen"))

    def step(state: Column, line: Column) -> Column:
        fence = F.ltrim(line).startswith("```")
        now = F.when(fence, ~state["open"]).otherwise(state["open"])
        return F.struct(now.alias("open"), F.concat(state["seen"], F.array(state["open"] | fence)).alias("seen"))

    return F.aggregate(lines, zero, step, lambda s: s["seen"])


def extract_tags(text: Column, markdown: Column) -> Column:
    """Array of (line, tag, value): the first ``@name:`` of every line that isn't a mention.

    Names are lower-cased, values trimmed. The line number is 1-based. Null text gives an empty array.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    rows = F.arrays_zip(F.sequence(F.lit(1), F.size(lines)).alias("no"), lines.alias("line"), fence_parity(lines).alias("fence"))
    hits = F.filter(rows, lambda r: r["line"].rlike(TAG_PATTERN) & ~is_mention(r["line"], r["fence"], markdown))
    return F.transform(
        hits,
        lambda r: F.struct(
            r["no"].alias("line"),
            F.lower(F.regexp_extract(r["line"], TAG_PATTERN, 1)).alias("tag"),
            trim_all(F.regexp_extract(r["line"], TAG_PATTERN, 2)).alias("value"),
        ),
    )


def strip_tags(text: Column, markdown: Column) -> Column:
    """The text without its tags; a line that holds nothing else vanishes."""
    lines = F.split(text, "\n")
    rows = F.arrays_zip(lines.alias("line"), fence_parity(lines).alias("fence"))

    def clean(r: Column) -> Column:
        tagged = r["line"].rlike(TAG_PATTERN) & ~is_mention(r["line"], r["fence"], markdown)
        whole = r["line"].rlike(r"^\s*@[a-zA-Z][\w.-]*:")
        return F.when(tagged & whole, F.lit(None)).when(tagged, F.regexp_replace(r["line"], TAG_PATTERN, "")).otherwise(r["line"])

    return F.array_join(F.transform(rows, clean), "\n")


def count_tags(text: Column) -> Column:
    """Names of all ``@name:`` in a text, lower-cased, with repetitions."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"@([a-zA-Z][\w.-]*):"), F.lit(1)), lambda t: F.lower(t))


def tag_block(text: Column) -> Column:
    """Leading ``@name: value`` lines of a text as an array of (name, value), up to the first other line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    pattern = r"^@([a-zA-Z][\w.-]*):[ \t]*(.*)$"
    zero = F.struct(F.lit(True).alias("on"), F.array().cast("array<struct<name:string,value:string>>").alias("got"))

    def step(s: Column, line: Column) -> Column:
        hit = s["on"] & line.rlike(pattern)
        row = F.struct(F.lower(F.regexp_extract(line, pattern, 1)).alias("name"), trim_all(F.regexp_extract(line, pattern, 2)).alias("value"))
        return F.struct(hit.alias("on"), F.when(hit, F.concat(s["got"], F.array(row))).otherwise(s["got"]).alias("got"))

    return F.aggregate(lines, zero, step, lambda s: s["got"])


def tag_block_get(block: Column, name: str) -> Column:
    """Value of the first line of a tag block that has ``name``; null if there is none."""
    return F.element_at(F.transform(F.filter(block, lambda r: r["name"] == name.lower()), lambda r: r["value"]), 1)


def tag_definitions(text: Column) -> Column:
    """Map from tag name to description of the ``@tag: NAME DESCRIPTION`` lines; the last one wins."""
    pattern = r"(?m)^@tag:[ \t]+([\w.-]+)[ \t]+(.*)$"
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(F.transform(names, lambda n: F.lower(n)).alias("name"), texts.alias("text"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def chapter_verse(text: Column) -> Column:
    """(chapter, verse) of ``3:16``; null for other forms."""
    ok = F.when(text.rlike(r"^\s*\d{1,4}:\d{1,4}\s*$"), trim_all(text))
    return F.when(ok.isNotNull(), F.struct(F.split(ok, ":")[0].cast("int").alias("chapter"), F.split(ok, ":")[1].cast("int").alias("verse")))


def escape_anchor(text: Column) -> Column:
    """Back-slash escapes for a quoted anchor."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
