"""Per-document text statistics, and what kind of text most of a document's characters are.

A batch of texts is one array of code points (``words.points``); lines, words and their counts come from
array operations over it. Every line is judged on the evidence around it:

* tables: a delimiter (``|``, box rule, tab, ``;``, ``,``) that stands in equal number in neighbouring
  lines, or blank gutters at the same column of neighbouring lines (vertical alignment);
* lists: item marks, tag lines and links; bare entries, told from prose by ``ENTRY``: the lines' lengths
  and ends, the recurrence (autocorrelation) of their lengths and that of their indentation;
* junk: symbol share, words that can't be spoken, encoded runs, machine output (records, logs, stack
  frames), repetition of lines or phrases, and heaps of words without function words.

The characters of the lines of each kind are summed; the kind that holds most of them is the
document's. Machine repetition is judged on the whole text first. Thresholds and ``ENTRY`` are fixed, and
nothing is fitted at run time, so a result depends on the text alone; ``ENTRY`` was fitted on the
labelled documents with an even id and held against those with an odd one.

Edge cases: null, empty and blank texts have statistics of zero and kind null; very long texts are
read whole; repeated rows count once; ties between kinds go to prose, then list, table, junk; null
ids are dropped; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.llm import words as W

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK, NONE, TEXT = range(6)
#: Frequent function words of the corpus' languages.
COMMON = """the of and to in a is that it for on with as was are by this be at from or an not but we our every which when you there have
    has does my if only after before no so into while
    der die das und in zu den von mit auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    noch am vor seit zum zur doch aber
    el la los las de que y en un una por con no para su al lo como más pero del se es sin sobre entre hay desde antes
    le les des du et un une que qui dans pour pas sur au par il ne se ce plus avec sont mais aux est car on à sans""".split()
_COMMON = np.unique(W.word_codes([" ".join(COMMON)])[0])
_BULLET = r"(?:[-*+•‣◦–▪■□●○►▸→⇒✓✔✗☐☑☒]|\d{1,4}[.)]|[a-zA-Z][.)]|[-*+]?\s?\[[ xX]?\])\s+\S"
_LINK = r"(?:[-*+]\s+)?(?:\[\[[^\]]+\]\]|\[[^\]]+\]\([^)]+\)|https?://\S+)"
_LOG = r"[\[(]?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?\S*\s|\[?(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\b[\]:]?"
_FRAME = r"at\s+[\w.$<>/]+\(.*\)\s*$|File \"[^\"]+\", line \d+|#\d+\s+0x|Traceback"
LEAD = re.compile(rf"\s*(?:(?P<log>{_LOG}|{_FRAME})|(?P<head>#{{1,6}}\s)|(?P<mark>{_BULLET}|@[\w-]+:(?:\s|$))|(?P<link>{_LINK})|(?P<record>[\[{{].*[\"']?\w+[\"']?\s*:))", re.I)
LINK = re.compile(rf"\s*{_LINK}")
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{32,}|(?:[0-9a-fA-F]{2}[\s:]?){16,}|(?:%[0-9a-fA-F]{2}){6,}|(?:\\x[0-9a-fA-F]{2}){4,}|(?:&#?\w+;){4,}")
BREAK = re.compile(r"\r\n?")
DELIMITERS = "|│\t;,"
LAGS = 12
#: Weights of (1, mean of the mean and the median length / 40, share of lines near the longest, share of short open lines, share of lines with an inner
#: sentence end, recurrence of the lengths, recurrence of the indents); a positive sum makes a list. The first five are fitted
#: by ``fit_entries``; no labelled document has recurring lengths or indents, so the last two are set by hand.
ENTRY = np.array([1.82, -4.95, -2.42, 3.2, -1.79, 4.0, 8.0])
STATISTICS = (
    "n_chars n_words mean_word_length symbol_ratio digit_ratio end_punct_share common_share distinct_share "
    "n_lines mean_line_length line_spread line_autocorrelation indent_period delimiter_alignment bullet_share repeat_share"
).split()


def _per(keys: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Sums of values (or counts) per key."""
    return np.bincount(keys, values, n).astype(np.float64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _spread(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviation from the document's mean, mean, sum of squared deviations)."""
    mean = _share(_per(doc, n, values), _per(doc, n))
    off = values - mean[doc]
    return off, mean, _per(doc, n, off * off)


def autocorrelations(values: np.ndarray, doc: np.ndarray, n: int, lags: int = LAGS) -> np.ndarray:
    """(lags x n): the autocorrelation of each document's line values at the lags from 1 on; 0 where nothing varies.

    The later part of a series has fewer pairs, so a sum is scaled to the full length.
    """
    off, _, power = _spread(values.astype(np.float64), doc, n)
    size = _per(doc, n)
    out = np.zeros((lags, n))
    for lag in range(1, min(lags, len(values) - 1) + 1):
        same = doc[lag:] == doc[:-lag]
        total = _per(doc[lag:][same], n, (off[lag:] * off[:-lag])[same])
        ok = (power > 1e-9) & (size >= 2 * lag)
        out[lag - 1][ok] = (total * size / np.maximum(size - lag, 1))[ok] / power[ok]
    return out


def recurrence(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The strongest autocorrelation at a lag of two lines or more, from 0 (no more than chance gives) to 1."""
    best = autocorrelations(values, doc, n)[1:].max(0)
    chance = 2 / np.sqrt(np.maximum(_per(doc, n), 1))
    return np.where(chance < 0.9, np.clip((best - chance) / np.maximum(1 - chance, 0.1), 0, 1), 0.0)


def indentation(indent: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of the indented lines, as far as their indents recur: at one period, or as three levels or more."""
    low = np.full(n, np.inf)
    np.minimum.at(low, doc, indent)
    level, often = np.unique(doc * (1 << 20) + np.minimum(indent, (1 << 20) - 1).astype(np.int64), return_counts=True)
    levels = _per((level >> 20)[often >= 2], n) >= 3
    return _share(_per(doc, n, indent > low[doc]), _per(doc, n)) * np.maximum(recurrence(indent, doc, n), levels)


@dataclass
class Page:
    """A batch: its non-blank lines, their words and their counts, and the texts they belong to."""

    n: int  # texts
    lines: list[str]
    doc: np.ndarray  # of each line
    indent: np.ndarray
    size: np.ndarray  # length without the outer white space
    spoken: np.ndarray
    symbols: np.ndarray
    noise: np.ndarray
    rule: np.ndarray
    n_words: np.ndarray
    heap: np.ndarray
    ends: np.ndarray
    inner: np.ndarray
    cells: np.ndarray
    same: np.ndarray  # how often the line stands in its text
    facts: dict[str, np.ndarray]  # of each text
    dense: np.ndarray  # few blanks for its length


def _alike(counts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines of which a neighbour (up to two lines away) has the same positive count."""
    out = np.zeros(len(counts), bool)
    for k in (1, 2):
        if len(counts) > k:
            hit = (counts[k:] == counts[:-k]) & (counts[k:] > 0) & (doc[k:] == doc[:-k])
            out[k:] |= hit
            out[:-k] |= hit
    return out


def _cells_of(line: str, d: str, count: int) -> int:
    """Cells that a delimiter cuts a line into; 0 if the line reads like prose."""
    cells = [x.strip() for x in line.split(d)]
    cells = cells[1:-1] if d in "|│" and not cells[0] and not cells[-1] else cells
    if d in ";,":  # prose has these too: its parts are long and end in sentences
        bare = line.rstrip(d).rstrip().rstrip("\"'”’»)]")
        tight = sum(1 for k in range(len(line) - 1) if line[k] == d and line[k + 1] != " ")
        if tight * 2 < count or (d == "," and count < 2) or max(map(len, cells)) > 48 or bare[-1:] in W.STOPS or any(x.count(" ") > 6 for x in cells):
            return 0
    return len(cells)


def read_page(texts: list[str], all_facts: bool = False) -> Page:
    """Everything that is counted in a batch of texts; the facts that only statistics show are optional."""
    texts = [BREAK.sub("\n", x) if "\r" in x else x for x in texts]
    n = len(texts)
    text = "\n".join(texts)
    cp, kind = W.points(text)
    flag = lambda bit: (kind & bit) > 0
    ends = np.append(np.flatnonzero(cp == 10), len(cp))
    begins = np.concatenate([[0], ends[:-1] + 1])
    chars_of = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, n))
    solid = ~flag(W.SPACE)
    at = np.flatnonzero(solid)
    lo, hi = np.searchsorted(at, begins), np.searchsorted(at, ends)
    full = np.flatnonzero(hi > lo)  # lines that aren't blank
    begins, ends, lo, hi = begins[full], ends[full], lo[full], hi[full]
    doc = np.searchsorted(chars_of, begins, side="right")
    first, last = (at[lo], at[hi - 1] + 1) if len(full) else (begins, ends)
    n_lines = len(full)
    body = (hi - lo).astype(np.float64)

    def within(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[b] - total[a]).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        return within(mask, begins, ends)

    tab = cp == 9
    indent = (first - begins) + 3 * within(tab, begins, first)
    # words: runs of letters with an apostrophe inside
    letter = flag(W.LETTER)
    inner_mark = np.zeros(len(cp), bool)
    if len(cp) > 2:
        inner_mark[1:-1] = ((cp[1:-1] == 39) | (cp[1:-1] == 0x2019)) & letter[:-2] & letter[2:]
    wb, we = W.runs(letter | inner_mark)
    line_at = np.clip(np.searchsorted(begins, wb, side="right") - 1, 0, max(n_lines - 1, 0))
    size = (we - wb).astype(np.float64)
    inside = lambda mask: within(mask, wb, we)
    vowels, upper, lower = inside(flag(W.VOWEL)), inside(flag(W.UPPER)), inside(flag(W.LOWER))
    foreign = inside(cp > 127) > 0
    vowels = np.where(foreign & (vowels == 0), 1, vowels)
    good = ((size <= 2) & (vowels > 0)) | ((size > 2) & (vowels * 6 >= size)) | ((size <= 5) & (upper > 0) & (lower == 0))
    codes = W.span_codes(W.lowered(cp), wb, we)
    common = np.isin(codes, _COMMON)
    n_words = _per(line_at, n_lines)
    letters = _per(line_at, n_lines, size)
    spoken = np.where(letters > 0, _share(_per(line_at, n_lines, size * good), letters), 1.0)
    distinct = W.distinct(line_at, codes, n_lines)
    many = n_words >= 8
    heap = many & (_share(_per(line_at, n_lines, common), n_words) < 0.04) & ((_share(distinct, n_words) < 0.6) | (_per(line_at, n_lines, upper) == 0))
    # the last character that is neither blank nor a closing mark ends a sentence or doesn't
    open_at = np.flatnonzero(solid & ~flag(W.CLOSE))
    k = np.searchsorted(open_at, ends) - 1
    ends_line = np.zeros(n_lines, bool)
    if len(open_at):
        ends_line = (k >= 0) & (open_at[k] >= begins) & flag(W.STOP)[open_at[k]]
    stops = np.flatnonzero(np.isin(cp, (46, 33, 63, 0x2026)))
    stops = stops[(stops >= 2) & (stops + 2 < len(cp))] if len(cp) > 4 else stops[:0]
    stops = stops[letter[stops - 1] & letter[stops - 2] & (cp[stops + 1] == 32)]
    own = np.searchsorted(begins, stops, side="right") - 1
    inner = _per(own[stops < last[own] - 1], n_lines) > 0 if len(stops) else np.zeros(n_lines, bool)
    lines = [text[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
    # vertical alignment of delimiters, then of gutters
    cells = np.zeros(n_lines)
    for d in DELIMITERS:
        counts = count(cp == ord(d))
        for i in np.flatnonzero(_alike(counts, doc)).tolist():
            cells[i] = max(cells[i], _cells_of(lines[i], d, int(counts[i])))
    gap = np.flatnonzero(solid[2:] & (tab[1:-1] | ((cp[1:-1] == 32) & (cp[:-2] == 32)))) + 2 if len(cp) > 2 else np.zeros(0, np.int64)
    own = np.searchsorted(begins, gap, side="right") - 1
    keep = (own >= 0) & (gap > first[own]) if n_lines else np.zeros(0, bool)
    gap, own = gap[keep], own[keep]
    place = (own + 3 * doc[own]) * (1 << 20) + np.minimum(gap - begins[own], (1 << 20) - 1)  # texts lie three lines apart
    hit = np.zeros(len(gap), bool)
    for step in (-2, -1, 1, 2):
        hit |= np.isin(place + step * (1 << 20), place)
    gaps, hits = _per(own, n_lines), _per(own, n_lines, hit)
    gutter = (cells == 0) & (hits > 0) & (2 * hits >= gaps)
    for i in np.flatnonzero(gutter).tolist():
        if not re.match(rf"\s*{_BULLET}", lines[i]):
            cells[i] = hits[i] + 1
    line_codes = W.span_codes(cp, first, last)
    _, of, often = np.unique(W.mix(line_codes + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_inverse=True, return_counts=True)
    symbol = solid & ~flag(W.WORDS) & ~flag(W.SOFT)
    # runs of letters and digits: triples that repeat an earlier one
    tb, te = W.runs(flag(W.WORDS))
    tokens, token_doc = W.span_codes(W.lowered(cp), tb, te), np.searchsorted(chars_of, tb, side="right")
    repeat = np.zeros(n)
    if len(tokens) > 2:
        triple = W.mix(tokens[:-2] * np.uint64(3) + tokens[1:-1] * np.uint64(5) + tokens[2:] * np.uint64(7))
        whole = token_doc[:-2] == token_doc[2:]
        total = _per(token_doc[:-2][whole], n)
        once = W.distinct(token_doc[:-2][whole], triple[whole], n)
        repeat = np.where(total >= 10, 1 - _share(once, total), 0.0)
    solid_of = np.searchsorted(chars_of, at, side="right")
    facts = {"odd_ratio": _share(_per(solid_of, n, symbol[at]), _per(solid_of, n)), "repeat_share": repeat}
    if all_facts:
        word_doc = doc[line_at] if n_lines and len(wb) else np.zeros(0, np.int64)
        total = _per(word_doc, n)
        facts |= {
            "n_chars": np.fromiter(map(len, texts), np.float64, n),
            "n_words": total,
            "mean_word_length": _share(_per(word_doc, n, size), total),
            "symbol_ratio": _share(_per(solid_of, n, ~flag(W.WORDS)[at]), _per(solid_of, n)),
            "digit_ratio": _share(_per(solid_of, n, flag(W.DIGIT)[at]), _per(solid_of, n)),
            "common_share": _share(_per(word_doc, n, common), total),
            "distinct_share": _share(W.distinct(word_doc, codes if len(word_doc) else codes[:0], n), total),
        }
    return Page(
        n, lines, doc, indent, (last - first).astype(np.float64), spoken, _share(count(symbol), body), _share(count(flag(W.NOISE) & solid), body),
        count(flag(W.RULE)) == body, n_words, heap, ends_line, inner, cells, often[of.reshape(-1)], facts, count(cp == 32) * 10 < last - first,
    )


def line_kinds(page: Page) -> np.ndarray:
    """The kind of every line; headings and rules are ``NONE``, lines that nothing has claimed ``TEXT``."""
    n_lines = _per(page.doc, page.n)[page.doc]
    lead = np.array([{"log": 1, "head": 2, "mark": 3, "link": 4, "record": 5}[m.lastgroup] if (m := LEAD.match(x)) else 0 for x in page.lines], np.int8).reshape(-1)
    readable = (page.spoken > 0.5) & (page.symbols < 0.45)
    for i in np.flatnonzero((lead == 3) & ~readable).tolist():  # such a mark begins no item
        lead[i] = 4 if LINK.match(page.lines[i]) else 5 if page.lines[i].lstrip()[:1] in "[{" and ":" in page.lines[i] else 0
    encoded = np.zeros(len(lead))
    for i in np.flatnonzero((page.size > 12) & (page.dense | (page.spoken < 0.8) | (page.n_words == 0))).tolist():
        encoded[i] = sum(map(len, ENCODED.findall(page.lines[i])))
    rules = (
        ((page.same >= 4) & (page.same * 2 >= n_lines) & (page.size > 2), JUNK),
        (lead == 1, JUNK),
        (lead == 2, NONE),
        ((lead == 3) & readable, LIST),
        ((page.cells >= 2) & (page.noise < 0.25) & ((page.spoken > 0.5) | (page.n_words == 0)), TABLE),
        (page.rule, NONE),
        (lead == 4, LIST),
        ((lead == 5) & (page.symbols > 0.12), JUNK),
        ((page.symbols > 0.35) | (encoded * 2 > page.size), JUNK),
        ((page.n_words > 0) & (page.spoken < 0.6) & (page.size > 12), JUNK),
        (page.heap, JUNK),
    )
    return np.select([r for r, _ in rules], [k for _, k in rules], TEXT) if len(lead) else np.zeros(0, np.int64)


def entry_evidence(page: Page, open_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features x texts, lines): what tells bare entries from prose, over the lines that nothing has claimed."""
    doc, size = page.doc[open_lines], page.size[open_lines]
    count = _per(doc, page.n)
    longest = np.zeros(page.n)
    np.maximum.at(longest, doc, size)
    short = (size <= 60) & ~page.ends[open_lines]
    near = _share(_per(doc, page.n, size >= 0.75 * longest[doc]), count)
    order = np.lexsort((size, doc))
    middle = np.zeros(page.n)
    some = count > 0
    middle[some] = size[order][(np.cumsum(count) - count + count // 2).astype(np.int64)[some]]
    typical = (_share(_per(doc, page.n, size), count) + middle) / 2
    parts = (np.ones(page.n), typical / 40, near, _share(_per(doc, page.n, short), count), _share(_per(doc, page.n, page.inner[open_lines]), count), recurrence(size, doc, page.n), indentation(page.indent[open_lines], doc, page.n))
    return np.stack(parts), count


def kinds_of(texts: list[str]) -> np.ndarray:
    """The index of every text's kind; -1 for empty and blank texts."""
    page = read_page(texts)
    kind = line_kinds(page)
    evidence, count = entry_evidence(page, kind == TEXT)
    bare = (count >= 4) & (ENTRY @ evidence > 0)
    kind = np.where(kind == TEXT, np.where(bare[page.doc], LIST, PROSE), kind) if len(kind) else kind
    share = np.stack([_per(page.doc, page.n, page.size * (kind == k)) for k in range(len(KINDS))])
    best = share.argmax(0)
    best = np.where(share.max(0) > 0, best, np.where(page.facts["odd_ratio"] > 0.35, JUNK, PROSE))
    best = np.where((best <= LIST) & (page.facts["repeat_share"] > 0.5) & (share.max(0) > 0), JUNK, best)
    return np.where(_per(page.doc, page.n) > 0, best, -1)


def fit_entries(texts: list[str], is_list: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """``ENTRY`` by logistic regression: texts of open lines, and whether they are lists. Run once, by hand."""
    page = read_page(texts)
    evidence, count = entry_evidence(page, line_kinds(page) == TEXT)
    x, y = evidence[:, count >= 4], is_list[count >= 4].astype(np.float64)
    weights = np.zeros(len(x))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(weights @ x))) - y
        weights -= 0.5 * (x @ error / len(y) + 2e-4 * weights)
    return weights


def _batched(texts: list[str | None], work) -> Iterator:
    """``work`` over slabs of the texts, nulls as empty."""
    plain = [x or "" for x in texts]
    for a, b, _ in W.slabs(plain):
        yield work(plain[a:b])


def statistics(texts: list[str]) -> np.ndarray:
    """(texts x ``STATISTICS``)."""
    page = read_page(texts, all_facts=True)
    count = _per(page.doc, page.n)
    _, mean, power = _spread(page.size, page.doc, page.n)
    marked = np.array([bool(m := LEAD.match(x)) and m.lastgroup in ("mark", "link") for x in page.lines], bool).reshape(-1)
    share = lambda mask: _share(_per(page.doc, page.n, mask), count)
    own = page.facts | {
        "end_punct_share": share(page.ends),
        "n_lines": count,
        "mean_line_length": mean,
        "line_spread": np.sqrt(_share(power, count)),
        "line_autocorrelation": autocorrelations(page.size, page.doc, page.n, 1)[0],
        "indent_period": indentation(page.indent, page.doc, page.n),
        "delimiter_alignment": share(page.cells >= 2),
        "bullet_share": share(marked),
    }
    return np.stack([own[name] for name in STATISTICS], axis=1)


def _names(kinds: np.ndarray) -> list[str | None]:
    return [None if k < 0 else KINDS[k] for k in kinds.tolist()]


def kind_of(text: str | None) -> str | None:
    """The kind of most of a text's characters; null for null, empty and blank texts."""
    return _names(kinds_of([text or ""]))[0]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        kinds = [k for part in _batched(texts, kinds_of) for k in _names(part)]
        values = np.concatenate([*_batched(texts, statistics), np.zeros((0, len(STATISTICS)))])
        cols = [batch.column("id"), pa.array(kinds, pa.string())] + [pa.array(np.round(values[:, k], 6)) for k in range(len(STATISTICS))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "kind", *STATISTICS])


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [k for part in _batched(batch.column("text").to_pylist(), kinds_of) for k in _names(part)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kinds, pa.string())], names=["id", "kind"])


def text_statistics(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, statistics...) per row; a narrow operation."""
    slim = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(_run, "id long, kind string, " + ", ".join(f"{n} double" for n in STATISTICS))
    return out.withColumnRenamed("id", id_col)


def text_kinds(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind) per distinct id and kind."""
    slim = rows.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_kinds, "id long, kind string").filter("kind is not null").distinct().withColumnRenamed("id", id_col)
