"""Near-duplicate records by Order MinHash, verified by banded alignment.

Signature
    A text gives its ``KMER``-word runs, each labelled with how often it has occurred before in the
    text. Each of ``TABLES`` independent hash functions picks the ``SAMPLE`` smallest labelled
    k-mers; the picked ones, *in text order*, make one signature value. Two texts collide in a table
    if the same k-mers are smallest in both and stand in the same order, so the probability falls
    with edits as well as with reordering.
Candidates
    Equal texts are one class first, whatever their number: only its smallest id is signed, where its row
    lies. Equal signature values give candidate pairs by equi-joins, ``TABLES / PASSES`` tables at a time; no group is collected, no bucket capped.
    Each signature row carries 128 bits: the text's shingle count and three bits of every table's
    minimum. Inside the join they drop pairs whose sizes rule the threshold out, or whose minima
    agree too rarely (``least_equal`` of ``TABLES``; a pair at the threshold fails the default about
    three times in ten thousand; 0 switches the test off).
Closure
    Two texts that are both likely candidates with a third are a candidate pair too; this finds most of the few
    pairs that no table brought together.
Verification
    All candidates at once, over the texts that are in one. A pair is aligned within a band around the diagonal, in
    numpy over batches. ``d`` edited words change at most ``3 d`` shingles on either side, so a small distance proves the
    similarity; only where it doesn't (or the alignment left its band, as whole passages were moved) are the shingle sets
    intersected exactly. ``edits`` is the alignment's distance, -1 where it proved nothing.

Edge cases: null texts and ids, and texts under ``MIN_WORDS`` words, take no part; a repeated row
counts once (of several texts under one id, each is compared; copies are those of the text with the smallest
digest); other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.llm import words as W
from lorefield.session import discard, materialise

KMER = 4
SHINGLE = 3
SAMPLE = 2
TABLES = 32
#: The tables are joined in so many passes, each with the disk of its share; texts are signed once.
PASSES = 4
MIN_WORDS = 20
BAND = 12
LEAST_EQUAL = 9
#: Minima that agree in a candidate pair over which the closure goes: most pairs at the threshold have more.
HOP_EQUAL = 14
FAR = 1 << 28
#: Members of a class of equal texts that are paired in one task.
PORTION = 2000
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=64)
def _odd(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd multipliers; made once, as a generator costs more than hashing a short text."""
    return np.random.default_rng(seed).integers(1, 1 << 63, size=count, dtype=np.uint64) | np.uint64(1)


def kmer_codes(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """One code per run of ``k`` words that begins at a position of ``at``."""
    weights = _odd(k, 11)
    acc = codes[at] * weights[0]
    for j in range(1, k):
        acc = acc + codes[at + j] * weights[j]
    return W.mix(acc)


def _labelled(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Codes in which the r-th repetition of a k-mer within its text differs from the first."""
    both = W.mix(code + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    if not same.any():
        return code
    run = np.concatenate([[False], same])
    where = np.arange(len(code))
    first = np.maximum.accumulate(np.where(run, 0, where))
    label = np.zeros(len(code), np.uint64)
    label[order] = (where - first).astype(np.uint64)
    return np.where(label > 0, W.mix(code + label * np.uint64(0x9E3779B97F4A7C15)), code)


def signatures(codes: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signature values (texts x TABLES) and sketches (texts x 2).

    ``codes`` and ``offsets`` hold the words of texts of at least ``KMER + SAMPLE - 1`` words each.
    """
    n = len(offsets) - 1
    at = W.windows(offsets, KMER)
    doc = np.searchsorted(offsets, at, side="right") - 1
    sizes = np.diff(offsets) - KMER + 1
    starts = np.cumsum(sizes) - sizes
    code = _labelled(kmer_codes(codes, at, KMER), doc)
    mult, add, join = _odd(TABLES, 12), _odd(TABLES, 13), _odd(SAMPLE, 14)
    values = np.empty((n, TABLES), np.uint64)
    sketch = np.zeros((n, 2), np.uint64)
    triple = W.windows(offsets, SHINGLE)
    shingles = W.distinct(np.searchsorted(offsets, triple, side="right") - 1, kmer_codes(codes, triple, SHINGLE), n)
    sketch[:, 0] = np.minimum(shingles, 65535).astype(np.uint64) << np.uint64(48)
    half = TABLES // 2
    for t in range(TABLES):
        v = (code ^ add[t]) * mult[t]
        v ^= v >> np.uint64(31)
        picked = []
        for s in range(SAMPLE):
            low = np.minimum.reduceat(v, starts)
            if s == 0:
                bits = (low >> np.uint64(7)) & np.uint64(7)
                sketch[:, t // half] |= bits << np.uint64(3 * (t % half))
            hit = np.flatnonzero(v == np.repeat(low, sizes))
            if len(hit) != n:  # two k-mers with one hash value: the first counts
                _, at_first = np.unique(doc[hit], return_index=True)
                hit = hit[at_first]
            picked.append(hit)
            v[hit] = TOP
        rank = np.sort(np.stack(picked, axis=1), axis=1)
        acc = np.full(n, (t + 1 + TABLES * salt) * 0x9FB21C651E98DF25 % (1 << 64), np.uint64)
        for s in range(SAMPLE):
            acc = W.mix(acc + code[rank[:, s]] * join[s])
        values[:, t] = acc
    return values, sketch


def alignment_distance(a: list[np.ndarray], b: list[np.ndarray], band: int = BAND, most: np.ndarray | None = None) -> np.ndarray:
    """Upper bounds of the edit distances (in words) of the pairs, by alignment within a band.

    A pair whose every alignment costs more than ``most`` gets ``FAR``, as does one that leaves the band.

    The band follows the straight line between the corners, ``band`` cells to either side of it, so
    a bound is exact if the best alignment stays inside. All pairs advance together, row by row.
    """
    n = np.array([len(x) for x in a])
    m = np.array([len(x) for x in b])
    rows, width = int(n.max(initial=0)), 2 * band + 1
    limit = most
    pad_b = np.zeros((len(b), int(m.max(initial=0)) + 1), np.uint64)
    for i, x in enumerate(b):
        pad_b[i, : len(x)] = x
    pad_a = np.zeros((len(a), rows), np.uint64)
    for i, x in enumerate(a):
        pad_a[i, : len(x)] = x
    far = np.int32(FAR)
    own = np.arange(len(a))  # the pairs that are still aligned
    offs = np.arange(width, dtype=np.int64) - band
    centre = np.zeros(len(a), np.int64)
    cols = offs[None, :] + centre[:, None]
    ok = (cols >= 0) & (cols <= m[:, None])
    cost = np.where(ok, cols, far).astype(np.int32)
    result = np.full(len(a), far, np.int32)

    def finish(at: np.ndarray) -> None:
        k = m[at] - centre[at] + band
        inside = (k >= 0) & (k < width)
        result[own[at[inside]]] = cost[at[inside], k[inside]]

    if (n == 0).any():
        finish(np.flatnonzero(n == 0))
    slope = m / np.maximum(n, 1)
    step = np.arange(width, dtype=np.int32)
    for i in range(1, rows + 1):
        following = np.minimum(np.rint(slope * i), m).astype(np.int64)
        shift = following - centre
        centre = following
        cols = offs[None, :] + centre[:, None]
        ok = (cols >= 0) & (cols <= m[:, None])
        # cell (i-1, j) and (i-1, j-1) in the coordinates of the row before
        k = np.arange(width)[None, :] + shift[:, None]
        up = np.where(k < width, np.take_along_axis(cost, np.clip(k, 0, width - 1), 1), far)
        k = k - 1
        diag = np.where((k >= 0) & (k < width), np.take_along_axis(cost, np.clip(k, 0, width - 1), 1), far)
        other = np.take_along_axis(pad_b, np.clip(cols - 1, 0, pad_b.shape[1] - 1), 1)
        best = np.minimum(up + 1, diag + (other != pad_a[:, i - 1][:, None]))
        best = np.where(cols == 0, np.int32(i), best)
        best = np.where(ok, best, far)
        best = np.minimum.accumulate(best - step, axis=1) + step  # cells reached from the left
        cost = np.where(ok, np.minimum(best, far), far).astype(np.int32)
        ends = np.flatnonzero(n == i)
        if len(ends):
            finish(ends)
        if most is not None and i % 8 == 0:
            going = (n > i) & (cost.min(1) <= most)
            if going.sum() * 4 < len(own) * 3:
                own, n, m, centre, slope, cost, pad_a, pad_b, most = (x[going] for x in (own, n, m, centre, slope, cost, pad_a, pad_b, most))
                if not len(own):
                    break
    return result if most is None else np.where(result > limit, far, result)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of distinct shingles of either text that are in both (sorted arrays of distinct codes)."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def proven(distance: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a distance in words proves the similarity of texts with ``a`` and ``b`` different shingles."""
    common = np.maximum(np.maximum(a, b) - SHINGLE * distance.astype(np.float64), 0)
    return common >= threshold * np.maximum(a + b - common, 1) - 1e-9


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, tabs = (batch.column(c).to_pylist() for c in ("text", "id", "tab"))
        for tab in sorted(set(tabs)):
            own = list(dict.fromkeys((i, x) for i, x, t in zip(ids, texts, tabs) if t == tab))
            for a, b, _ in W.slabs([x for _, x in own]):
                codes, offsets = W.word_codes([x for _, x in own[a:b]])
                size = np.diff(offsets)
                long = size >= MIN_WORDS
                if not long.any():
                    continue
                codes, offsets = codes[np.repeat(long, size)], np.concatenate([[0], np.cumsum(size[long])])
                values, sketch = signatures(codes, offsets, salt=tab)
                sketch[:, 1] |= np.uint64(tab) << np.uint64(48)
                keys = np.array([i for i, _ in own[a:b]], np.int64)[long]
                marks = sketch.view(np.int64)
                each = TABLES // PASSES
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * each)
                parts = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values[:, k * each : (k + 1) * each]).reshape(-1).view(np.int64))) for k in range(PASSES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), *parts],
                    names=["id", "s0", "s1", *(f"sigs{k}" for k in range(PASSES))],
                )


def farthest(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The largest distance that still proves the similarity of texts with ``a`` and ``b`` different shingles."""
    return np.floor((np.maximum(a, b) - threshold / (1 + threshold) * (a + b) + 1e-9) / SHINGLE).astype(np.int64)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple[int, int, int], str, str]]]:
    """Pairs of texts in portions of a few slabs; a repeated row counts once."""
    out: dict[tuple[tuple[int, int, int], str, str], None] = {}
    held = 0
    for batch in batches:
        for tab, a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("tab", "a", "b", "text_a", "text_b"))):
            out[(tab, a, b), x, y] = None
            held += len(x) + len(y)
            if held > W.SLAB * 4:
                yield list(out)
                out, held = {}, 0
    if out:
        yield list(out)


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _paired(batches):
            texts = list(dict.fromkeys(x for _, *both in rows for x in both))
            number = {x: k for k, x in enumerate(texts)}
            codes, offsets = W.word_codes(texts)
            words = [codes[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
            sets = [np.unique(kmer_codes(w, np.arange(max(0, len(w) - SHINGLE + 1)), SHINGLE)) for w in words]
            pairs = np.array([(number[x], number[y]) for _, x, y in rows], np.int64).reshape(-1, 2)
            size = np.array([len(x) for x in sets], np.float64)[pairs]
            most = farthest(size[:, 0], size[:, 1], threshold)
            edits = np.full(len(pairs), -1, np.int64)
            order = np.flatnonzero(most >= 0)
            order = order[np.argsort([len(words[k]) for k in pairs[order, 0]], kind="stable")]
            for at in range(0, len(order), 512):
                own = order[at : at + 512]
                dist = alignment_distance([words[k] for k in pairs[own, 0]], [words[k] for k in pairs[own, 1]], most=most[own])
                edits[own] = np.where(dist < FAR, dist, -1)
            alike = (edits >= 0) & proven(edits, size[:, 0], size[:, 1], threshold)
            for i in np.flatnonzero(~alike).tolist():
                alike[i] = jaccard(sets[pairs[i, 0]], sets[pairs[i, 1]]) >= threshold - 1e-12
            best: dict[tuple[int, int, int], int] = {}
            for i in np.flatnonzero(alike).tolist():
                best[rows[i][0]] = max(best.get(rows[i][0], -1), int(edits[i]))
            cols = list(zip(*[(*key, e) for key, e in best.items()])) if best else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["tab", "a", "b", "edits"])

    return run


def _agree() -> Column:
    """Number of tables whose minimum has the same three bits in both sketches."""
    mask = sum(1 << (3 * i) for i in range(TABLES // 2))

    def equal(name: str) -> Column:
        x = F.col(f"l.{name}").bitwiseXOR(F.col(f"r.{name}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.lit(TABLES // 2) - F.bit_count(any_bit.bitwiseAND(F.lit(mask)))

    return equal("s0") + equal("s1")


def prepare(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows (tab, id, text) of all tables; ``tables`` maps a name to (rows, id column, text column)."""
    out = None
    for tab, (rows, id_col, text_col) in enumerate(tables.values()):
        one = rows.select(F.lit(tab).alias("tab"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        one = one.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1))
        out = one if out is None else out.unionByName(one)
    return out


def near_duplicates(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = 0.6, least_equal: int = LEAST_EQUAL) -> tuple[DataFrame, DataFrame, list[str]]:
    """Links between different texts, and the classes of equal texts.

    Returns ``(links, members, names)``: ``links(tab, a, b, edits)`` holds one row per pair of class
    representatives whose shingle similarity is at least ``threshold`` (``edits`` bounds their word
    edit distance, -1 if the alignment proved nothing); ``members(tab, id, rep, n)`` holds the ids of
    every class of two or more equal texts and its size. ``names[tab]`` is the table's name.
    """
    names = list(tables)
    rows = prepare(tables)
    keyed = rows.select("tab", "id", F.unhex(F.md5("text")).alias("key")).groupBy("tab", "id").agg(F.min("key").alias("key"))
    classes = keyed.groupBy("tab", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    members = materialise(keyed.join(classes, ["tab", "key"]).select("tab", "id", "rep", "n"), "nd-members")
    # the ids that stand for no class leave the scan; where they are many, this shuffles the texts, so it is done once and kept
    texts = materialise(rows.join(members.filter("id <> rep").select("tab", "id"), ["tab", "id"], "left_anti"), "nd-texts")

    parts = ", ".join(f"sigs{k} array<long>" for k in range(PASSES))
    signed = materialise(texts.select("tab", "id", "text").mapInArrow(_sign_batches, f"id long, s0 long, s1 long, {parts}"), "nd-signatures")
    direct = None
    for k in range(PASSES):
        one = materialise(_colliding(signed.select("id", "s0", "s1", F.explode(f"sigs{k}").alias("sig")), threshold, least_equal), "nd-direct")
        direct = one if direct is None else direct.unionByName(one)
    discard(signed)
    likely, direct = direct.filter(F.col("equal") >= min(HOP_EQUAL, TABLES)).drop("equal").distinct(), direct.drop("equal")
    both = likely.unionByName(likely.select("tab", F.col("b").alias("a"), F.col("a").alias("b")))
    hop = both.alias("x").join(both.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")))
    hop = hop.select(F.col("x.tab").alias("tab"), F.col("x.b").alias("a"), F.col("y.b").alias("b"))
    pairs = materialise(direct.unionByName(hop).distinct(), "nd-pairs")
    return materialise(_verify(pairs, texts, threshold), "nd-links"), members, names


def _colliding(sig: DataFrame, threshold: float, least_equal: int) -> DataFrame:
    """Pairs of texts that share a signature value and pass both tests of their sketches."""
    l, r = sig.alias("l"), sig.alias("r")
    size_l, size_r = F.shiftrightunsigned(F.col("l.s0"), 48), F.shiftrightunsigned(F.col("r.s0"), 48)
    possible = (F.greatest(size_l, size_r) >= 65535) | (F.least(size_l, size_r) + 1e-9 >= threshold * F.greatest(size_l, size_r))
    return (
        l.join(r.hint("shuffle_hash"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.id") < F.col("r.id")))
        .filter(possible & (_agree() >= least_equal))
        # of both sides, lest an inferred filter on one side keep the two from sharing one exchange
        .select(F.greatest(F.shiftrightunsigned(F.col("l.s1"), 48), F.shiftrightunsigned(F.col("r.s1"), 48)).cast("int").alias("tab"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), _agree().alias("equal"))
        .groupBy("tab", "a", "b")
        .agg(F.max("equal").alias("equal"))
    )


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that hold. The texts are shuffled once, for both joins, and one text of each pair on the way to the other.

    Both joins are shuffles at every size, so the plan of a small input is that of a large one.
    """
    for end in ("a", "b"):
        one = texts.select("tab", "id", F.col("text").alias(f"text_{end}")).hint("merge")
        pairs = pairs.withColumn("id", F.col(end)).join(one, ["tab", "id"]).drop("id")
    held = pairs.select("tab", "a", "b", "text_a", "text_b").mapInArrow(_verifier(threshold), "tab int, a long, b long, edits long")
    return held.groupBy("tab", "a", "b").agg(F.max("edits").alias("edits"))


def expand(links: DataFrame, members: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """Every pair of ids: links between classes for all their members, and pairs within a class."""
    of = members.select("tab", F.col("rep"), "id")
    across = (
        links.join(of.select("tab", F.col("rep").alias("a"), F.col("id").alias("ia")), ["tab", "a"], "left")
        .join(of.select("tab", F.col("rep").alias("b"), F.col("id").alias("ib")), ["tab", "b"], "left")
        .select("tab", F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    )
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    long_enough = (
        texts.join(members.select("tab", F.col("rep").alias("id")).distinct(), ["tab", "id"], "left_semi")
        .filter(words >= MIN_WORDS)
        .select("tab", F.col("id").alias("rep"))
        .distinct()
    )
    own = members.join(long_enough, ["tab", "rep"], "left_semi")
    # a class is paired in portions: one side is dealt out, the other goes to every portion
    portions = F.ceil(F.col("n") / PORTION).cast("int")
    one = own.select("tab", "rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), portions).cast("int").alias("portion"))
    all_of = own.select("tab", "rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))
    within = one.join(all_of, ["tab", "rep", "portion"]).filter("x < y").select("tab", "x", "y")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tab") + 1)
    return across.unionByName(within).select(label.alias("src"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(links: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """Pairs between class representatives, with the number of copies each stands for."""
    n = members.select("tab", "rep", "n").distinct()
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("tab") + 1)
    return (
        links.join(n.select("tab", F.col("rep").alias("a"), F.col("n").alias("na")), ["tab", "a"], "left")
        .join(n.select("tab", F.col("rep").alias("b"), F.col("n").alias("nb")), ["tab", "b"], "left")
        .select(label.alias("src"), F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.coalesce("na", F.lit(1)).alias("copies_a"), F.coalesce("nb", F.lit(1)).alias("copies_b"), "edits")
    )
