"""Encoding of whole texts with byte_bpe_50k, as a tree reduction over a monoid.

An element is ``(begin, end, ids)``: a span of the text and its token ids. Every text is halved until the
parts are at most ``LEAF`` characters long; these leaves are encoded, and neighbours are joined pair by
pair up the tree. A join encodes a window around the seam again. The window grows from ``FIRST_WINDOW``
characters to either side until it holds a *safe* offset on both (an element's own edge counts as safe,
as nothing lies beyond it that could change); it is then cut down to the safe offsets nearest to the
seam. If the seam itself is safe, nothing is encoded again. All leaves of a batch are encoded in one
call, and so are all windows of one level of its trees.

Why tokens outside are final: the tokenizer first cuts a text into pre-tokens, and no merge crosses a
cut. At an offset p where the character before is a letter, a digit or a mark (any character that is
neither letter, digit nor white space), and the one behind is of another of the four classes, every
branch of the pre-tokenizer's pattern ends at p, whatever stands around it; the one exception is the
apostrophe, which may begin a contraction. The pattern's only look-ahead follows white space, and the
character before p is none. So a text equals its two parts at p, each encoded alone. The tokens of a
byte-level vocabulary spell the text's bytes, so the bytes between a safe offset and the seam say how
many tokens of an element the window replaces.

The concatenation is associative with the empty text as unit. Decoding concatenates the tokens' bytes.

Edge cases: null and empty texts give an empty list; a repeated row gives its list again; a very long text
costs its length per level of its tree at worst (one pre-token without end), else its length plus a few
characters per seam; strings of special tokens are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256
FIRST_WINDOW = 16
VOCABULARY = os.environ.get("LOREFIELD_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: A safe offset lies behind one character of a class and before one of another.
SAFE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are then ordinary text
    return t


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> list[int]:
    """How many bytes of text each token spells; a byte is one character of a vocabulary entry."""
    vocabulary = tokenizer(path).get_vocab()
    out = [0] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


Element = tuple[int, int, list[int]]


class Encoder:
    """Encodes batches of texts by tree reduction; ``leaf`` bounds the text that is encoded at once below the seams."""

    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF, window: int = FIRST_WINDOW):
        self.raw, self.bytes, self.leaf, self.window = tokenizer(path), byte_lengths(path), leaf, window
        self.joined = 0  # characters that joins have encoded again

    def direct(self, text: str) -> list[int]:
        return self.raw.encode(text, add_special_tokens=False).ids if text else []

    def _spans(self, texts: list[str]) -> list[list[int]]:
        """Ids of many pieces of text, each encoded alone; empty ones cost nothing."""
        out: list[list[int]] = [[] for _ in texts]
        some = [i for i, x in enumerate(texts) if x]
        for i, e in zip(some, self.raw.encode_batch([texts[i] for i in some], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of every text; the trees of all texts are reduced together, level by level."""
        leaves = [(i, a, b) for i, x in enumerate(texts) if x for a, b in self._leaves(len(x))]
        rows: dict[int, list[Element]] = {}
        for (i, a, b), ids in zip(leaves, self._spans([texts[i][a:b] for i, a, b in leaves])):
            rows.setdefault(i, []).append((a, b, ids))
        while open_rows := [i for i, row in rows.items() if len(row) > 1]:
            seams = [(i, *self._seam(texts[i], left, right)) for i in open_rows for left, right in zip(rows[i][::2], rows[i][1::2])]
            windows = iter(zip(seams, self._spans([texts[i][p:q] for i, p, q in seams])))
            for i in open_rows:
                row = rows[i]
                rows[i] = [self._join(texts[i], left, right, *next(windows)) for left, right in zip(row[::2], row[1::2])] + row[len(row) // 2 * 2 :]
        return [rows[i][0][2] if i in rows else [] for i in range(len(texts))]

    def _leaves(self, n: int) -> list[tuple[int, int]]:
        parts = 1
        while n > parts * self.leaf:
            parts *= 2
        cuts = [n * k // parts for k in range(parts + 1)]
        return list(zip(cuts, cuts[1:]))

    def _seam(self, text: str, left: Element, right: Element) -> tuple[int, int]:
        """The window between the nearest safe offsets to either side of the seam."""
        low, seam, high = left[0], left[1], right[1]
        begin = end = -1
        width = self.window
        while begin < 0 or end < 0:
            a, b = max(low, seam - width), min(high, seam + width)
            if begin < 0:
                found = [m.start() for m in SAFE.finditer(text, a + 1, seam + 1)]
                begin = found[-1] if found else low if a == low else -1
            if end < 0:
                hit = SAFE.search(text, seam, b)
                end = hit.start() if hit else high if b == high else -1
            width *= 2
        return begin, end

    def _join(self, text: str, left: Element, right: Element, seam: tuple[int, int, int], window: list[int]) -> Element:
        _, begin, end = seam
        self.joined += end - begin
        head, tail = left[2], right[2]
        keep, drop = len(head), len(text[begin : left[1]].encode())
        while drop > 0:
            keep -= 1
            drop -= self.bytes[head[keep]]
        skip, over = 0, len(text[right[0] : end].encode())
        while over > 0:
            over -= self.bytes[tail[skip]]
            skip += 1
        return left[0], right[1], head[:keep] + window + tail[skip:]


def encode_texts(texts: list[str | None], path: str = VOCABULARY, leaf: int = LEAF) -> list[list[int]]:
    """Token ids of a batch of texts."""
    return Encoder(path, leaf).encode_all(texts)


def _batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                ids = encode_texts(texts[at : at + 512], path)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 512), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode_table(rows: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id column, ids): the token ids of every row's text. A narrow operation: nothing shuffles."""
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)[id_col]
    return slim.mapInArrow(_batches(path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``: the tokens' bytes, one after the other."""
    return tokenizer(path).decode(ids, skip_special_tokens=False)
