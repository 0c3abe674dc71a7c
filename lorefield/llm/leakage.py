"""Evaluation texts leaking into a corpus, by spaced-seed hashing.

Every window of ``SPAN`` consecutive words is hashed under fixed masks that each ignore two of its
positions; a document and a test item that agree at a mask's kept positions share a seed value, even
if an ignored word was replaced. The test side's seeds are a sorted table, joined with the corpus'
seeds where the documents lie: no document and no hash of one leaves its task. Hits are reduced to
(document, item, diagonal), where the diagonal is the offset between the two word positions, and verified on
the words around the hit along the diagonal:

* ``exact`` is the longest run of equal words,
* ``tolerant`` the longest stretch in which at least ``APART`` equal words lie between two replaced ones.

Nothing is lost. Every mask finds every ``SPAN`` words shared in order. A window of ``SPAN`` words within a tolerant
stretch holds one replaced word or two that are more than ``APART`` apart, and ``IGNORED`` names every such place.

The test side is broadcast only up to ``MOST_CHARS`` characters, which bounds its words (at most half as many) and
seeds; a larger one is cut into blocks by a hash of the item, and every block is searched in a pass of its own.

Words are maximal runs of letters and digits of the lower-cased text. Edge cases: null and empty texts
and texts under ``SPAN`` words take part in nothing; a repeated row counts once (of several texts
under one id each is searched); null ids are dropped; copies of a passage give one row per document and
item; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.llm import words as W

SPAN = 8
APART = 4
#: The positions each mask ignores. Every position is in one, and so is every pair more than ``APART`` apart.
IGNORED = ((0, 5), (1, 6), (2, 7), (0, 6), (1, 7), (0, 7), (3, 4))
MOST_CHARS = 4_000_000
_ODD = np.random.default_rng(21).integers(1, 1 << 63, size=SPAN, dtype=np.uint64) | np.uint64(1)


def seeds(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, masks x positions): the seed values of every window that lies within one text."""
    at = W.windows(offsets, SPAN)
    parts = [codes[at + p] * _ODD[p] for p in range(SPAN)]
    whole = reduce(np.add, parts)
    return at, np.stack([W.mix(whole - parts[i] - parts[j] + np.uint64(k)) for k, (i, j) in enumerate(IGNORED)])


def along(equal: np.ndarray) -> tuple[int, int]:
    """(exact, tolerant) of a diagonal: its longest run and its longest stretch with replaced words apart."""
    cuts = np.flatnonzero(~equal)
    runs = np.diff(np.concatenate([[-1], cuts, [len(equal)]])) - 1
    exact, far, stretch = int(runs.max()), 0, 0
    for run in runs.tolist():
        stretch += run
        if run:
            far = max(far, stretch)
        stretch = stretch + 1 if run >= APART else 0
    return exact, far


class TestSide:
    """The test items of one block: word codes, and a sorted seed table behind a table of bits."""

    __test__ = False

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.codes, self.offsets = W.word_codes(texts)
        at, values = seeds(self.codes, self.offsets)
        flat, place = values.reshape(-1), np.tile(at, len(IGNORED))
        order = np.argsort(flat, kind="stable")
        self.seeds, self.places = flat[order], place[order]
        self.owner = np.searchsorted(self.offsets, self.places, side="right") - 1
        self.mask = np.uint64((1 << max(10, int(len(flat) * 16).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(flat & self.mask).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item id, exact, tolerant) of every text and item that share a seed."""
        codes, offsets = W.word_codes(texts)
        at, values = seeds(codes, offsets)
        found = []
        for own in values:
            some = np.flatnonzero(self.bits[(own & self.mask).astype(np.int64)])
            low, high = np.searchsorted(self.seeds, own[some]), np.searchsorted(self.seeds, own[some], side="right")
            times = high - low
            if not times.any():
                continue
            entry = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            place = np.repeat(at[some], times)
            text = np.searchsorted(offsets, place, side="right") - 1
            item = self.owner[entry]
            found.append(np.stack([text, item, (place - offsets[text]) - (self.places[entry] - self.offsets[item])]))
        if not found:
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, diagonal in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
            doc, test = codes[offsets[text] : offsets[text + 1]], self.codes[self.offsets[item] : self.offsets[item + 1]]
            low, high = max(0, -diagonal), min(len(test), len(doc) - diagonal)
            exact, far = along(test[low:high] == doc[low + diagonal : high + diagonal])
            old = best.get((text, item), (0, 0))
            best[text, item] = max(old[0], exact), max(old[1], far)
        return [(text, int(self.ids[item]), *scores) for (text, item), scores in best.items()]


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for a, b, _ in W.slabs(texts):
                rows = side.search(texts[a:b])
                cols = list(zip(*rows)) if rows else [()] * 4
                own = ids.take(pa.array([a + t for t in cols[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "item_id", "exact", "tolerant"])

    return run


def leaks(
    corpus_rows: DataFrame, item_rows: DataFrame, corpus_id: str = "doc_id", corpus_text: str = "text", item_id: str = "item_id", item_text: str = "text", most_chars: int = MOST_CHARS
) -> DataFrame:
    """(doc_id, item_id, exact, tolerant): the longest shared passages of every pair that shares a seed.

    A narrow pass over the corpus per block of the test side; what is shuffled at the end are the pairs found.
    """
    spark = corpus_rows.sparkSession

    def slim(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull() & (F.length(text) >= 2 * SPAN - 1)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    items, corpus = slim(item_rows, item_id, item_text).distinct(), slim(corpus_rows, corpus_id, corpus_text)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // most_chars))
    parts = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # about most_chars characters, see above
        shared = spark.sparkContext.broadcast(TestSide([r["id"] for r in own], [r["text"] for r in own]))
        parts.append(corpus.mapInArrow(_searcher(shared), "doc_id long, item_id long, exact long, tolerant long"))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"), F.max("tolerant").alias("tolerant"))
