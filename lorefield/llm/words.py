"""Code points, words and 64-bit word codes of whole batches of texts, in numpy.

A batch is one array of code points; what a character is comes from a table that learns every code point
it meets. A word's code is a polynomial over its code points modulo 2**64, mixed, so all words of a
batch are coded by a few array operations. Words are the maximal runs of letters and digits.
"""

from __future__ import annotations

import numpy as np

LETTER, DIGIT, SPACE, UPPER, LOWER, VOWEL = 1, 2, 4, 8, 16, 32
NOISE, SOFT, STOP, CLOSE, RULE = 64, 128, 256, 512, 1024
UNKNOWN = 1 << 15
WORDS = LETTER | DIGIT
#: Vowels with their marks, marks of code, marks of prose, ends and closers of sentences, rules of tables.
VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ")
NOISES, SOFTS, STOPS, CLOSES, RULES = (frozenset(x) for x in ("{}[]()<>\\^~#=$%&*+_/:@!?", ".,'’", ".!?…:;。！？", "\"'”’»)]", "|:+=-─━│┃├┤┼┌┐└┘┬┴╞╡╪═"))
#: A slab holds about this many characters, so that its arrays stay small.
SLAB = 1 << 18
_KIND = np.full(0x110000, UNKNOWN, np.uint16)
_LOWER = np.arange(0x110000, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64))


def _learn(code: int) -> None:
    c = chr(code)
    bits = DIGIT if c.isdecimal() else LETTER if c.isalnum() else 0
    bits |= (SPACE if c.isspace() else 0) | (UPPER if c.isupper() else 0) | (LOWER if c.islower() else 0) | (VOWEL if c.lower() in VOWELS else 0)
    for flag, chars in ((NOISE, NOISES), (SOFT, SOFTS), (STOP, STOPS), (CLOSE, CLOSES), (RULE, RULES)):
        bits |= flag if c in chars else 0
    _KIND[code] = bits
    low = c.lower()
    _LOWER[code] = ord(low) if len(low) == 1 else code


def points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and the kind bits of each."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[cp]
    fresh = kind == UNKNOWN
    if fresh.any():
        for c in np.unique(cp[fresh]).tolist():
            _learn(c)
        kind = _KIND[cp]
    return cp, kind


def lowered(cp: np.ndarray) -> np.ndarray:
    """Lower-case code points, one by one."""
    return _LOWER[cp]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_codes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for each span of code points; equal spans have equal codes."""
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)  # place within the span
    chars = cp[np.repeat(begin, size) + at].astype(np.uint64) + np.uint64(1)
    weight = _POWERS[at & 63] * ((at >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(chars * weight, first) + size.astype(np.uint64))


def distinct(keys: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of the keys 0..n-1 has."""
    if not len(keys):
        return np.zeros(n, np.int64)
    order = np.argsort(mixed := mix(codes + keys.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    fresh = np.concatenate([[True], mixed[order][1:] != mixed[order][:-1]])
    return np.bincount(keys[order[fresh]], minlength=n)


def windows(offsets: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` consecutive words of one text begin."""
    n = int(offsets[-1]) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    inside = np.ones(n, bool)
    for k in range(1, size):  # a window must not begin in one text and end in another
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return np.flatnonzero(inside)


def slabs(texts: list[str]):
    """(first, last, text) groups of consecutive texts of at most about ``SLAB`` characters, joined by newlines."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < SLAB:
            size += len(texts[to]) + 1
            to += 1
        yield at, to, "\n".join(texts[at:to])
        at = to


def _parts(text: str):
    """A very long text in parts that end between words; a word longer than a part is not cut."""
    at = 0
    while len(text) - at > SLAB:
        cut = at + SLAB
        while cut < len(text) and text[cut].isalnum() and text[cut - 1].isalnum():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the words of text i are ``codes[offsets[i]:offsets[i + 1]]``, lower-cased first."""
    low = [t.lower() for t in texts]
    codes, counts = [], np.zeros(len(low) + 1, np.int64)
    for at, to, joined in slabs(low):
        if to == at + 1 and len(joined) > SLAB:
            for part in _parts(joined):
                cp, kind = points(part)
                begin, end = runs((kind & WORDS) > 0)
                codes.append(span_codes(cp, begin, end))
                counts[at + 1] += len(begin)
            continue
        cp, kind = points(joined)
        begin, end = runs((kind & WORDS) > 0)
        codes.append(span_codes(cp, begin, end))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in low[at:to]), np.int64, to - at))
        counts[at + 1 : to + 1] = np.diff(np.searchsorted(begin, ends), prepend=0)
    return (np.concatenate(codes) if codes else np.empty(0, np.uint64)), np.cumsum(counts)
