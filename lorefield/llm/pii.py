"""Personal items in free text: a linear-chain conditional random field over word-shape features.

Tokens tile the text: words, groups of digits with their inner separators, mailbox-like strings,
single symbols and line ends, each with the white space before it. A token's features are its shape,
affixes, spelling (if the labelled table has it), kind in the name lexicon and whether it touches the
token before; a label sees the features of the tokens from ``-REACH`` to ``REACH`` and the classes
of its direct neighbours. Labels: other, email, phone, id_number, and begin and inside of address and
name.

Training maximises the likelihood of the rows of ``pii_examples`` (``ROWS`` rows: the documented
bound) by Adam with exact gradients from forward-backward. It runs on the driver once per labelled table and lexicon: the
weights are kept in the shared folder under a digest of both, and later sessions read them from there.

Decoding runs in numpy over whole batches. Features of a token type are looked up once and kept as
one row of a table, so a token costs ``2*REACH+1`` gathers. From the emissions follows an upper
bound of what any label but *other* can gain at each token; the best sum of these bounds over any run
of tokens around a token says whether an item could contain it. Where none could, *other* is provably
best, and only the remaining windows go through Viterbi. The result is that of Viterbi over whole texts.

By definition a name needs two parts, or a title before it, an address a street and a number, an email
a mailbox at a domain; what the model labels without them is dropped. A town on the line below a street
belongs to the street's address.

Edge cases: null and empty texts hold no items and redact to themselves; texts of any length are read
whole; a repeated row counts once; equal items at different places are different rows; null ids are
dropped; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import inspect
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.llm.pii_examples import PARTICLES, TITLES, Writer
from lorefield.session import checkpoint_dir

LABELS = ("O", "email", "phone", "id_number", "B-address", "I-address", "B-name", "I-name")
KIND = (None, "email", "phone", "id_number", "address", "address", "name", "name")
REACH = 4
ROWS = 18000
N = len(LABELS)
EPOCHS = 6
#: Share of the name words that the lexicon is taken from in training, as it knows only a part of those in use.
HIDDEN = 0.33
LAST = 3

_HOST = r"[^\W_](?:[\w\-]*[^\W_])?"
_TIE = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)"
_DOT = r"(?:\.|\(dot\)|\[dot\]| dot )"
MAILBOX = rf"[^\W_](?:[\w+\-.]|(?<=\w) dot (?=\w)|\(dot\))*(?:{_TIE}{_HOST}(?:{_DOT}{_HOST})+| at {_HOST}(?: ?(?:\(dot\)|\[dot\]) ?{_HOST}| dot {_HOST})+)"
_GAP = "[ \u00a0\u202f]"
#: Letters and digits in one: two letters with three pairs of digits and a letter, or capitals and digits mixed.
MIXED = rf"(?-i:[A-Z]{{2}}(?:{_GAP}?\d\d){{3}}{_GAP}?[A-Z](?!\w)|(?<!\w)(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z\d]{{7,14}}(?!\w)|(?<!\w)[XYZ]-?\d{{7}}-?[A-Z](?!\w))|(?<!\w)(?:\d{{8}}|\d\d[. ]\d{{3}}[. ]\d{{3}}){_GAP}?-?[A-Z](?!\w)"
DIGITS = rf"[+(]{{0,2}}\d+(?:(?:{_GAP}?[/.\-‐‑–−]{_GAP}?|{_GAP}?\(|\){_GAP}?|{_GAP})[(]?\d+)*(?:\)(?=\d))?(?-i:{_GAP}[A-Z]{_GAP}\d{{3}}(?!\w)|-?[A-Z]\d*(?!\w)|[a-z](?!\w))?"
TOKEN = re.compile(rf"[^\S\n]*\n|[^\S\n]*(?:{MAILBOX}|{MIXED}|{DIGITS}|(?:[^\W\d_][̀-ͯ]*)+(?:['’](?:[^\W\d_][̀-ͯ]*)+)*|[^\s])|[^\S\n]+$", re.I)
_MAILBOX = re.compile(MAILBOX, re.I)
BREAK = "\n"
_PLAIN = str.maketrans("\u00a0\u202f‐‑–−", "  ----")


def _fold(word: str) -> str:
    """Lower case without accents, for the lexicon."""
    low = word.lower().replace("ß", "ss")
    if low.isascii():
        return low
    return "".join(ch for ch in unicodedata.normalize("NFD", low) if not unicodedata.combining(ch))


_TITLES = frozenset(_fold(w.rstrip(".")) for ws in TITLES.values() for w in ws)
#: A single letter may be an initial as well: what it is, the model decides.
_TITLE_WORDS = frozenset(w for w in _TITLES if len(w) > 1)
_PARTICLE_WORDS = frozenset(w for ps in PARTICLES.values() for x in ps for p in x.replace(".", "").split() if len(w := _fold(p)) > 1 and "'" not in w)


def tokens_of(text: str) -> list[str]:
    """Tokens that tile ``text``."""
    return TOKEN.findall(text)


def normal(token: str) -> str:
    """The key of a token's type: digits lose their values, but for the first three of a group."""
    body = token.strip()
    if not body:
        return BREAK
    glue = "" if token[0] == body[0] else " "
    head = body.lstrip("+(")[:1]
    if len(body) >= 7 and head.isascii() and head.isupper() and any(c.isdigit() for c in body) and body.isascii() and not re.search(r"[^A-Z\d\s\-]", body):
        return glue + "\x04" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", body))
    if head.isdigit():
        body = body.translate(_PLAIN)
        if not body.isascii():
            body = "".join(str(unicodedata.decimal(ch, 0)) if ch.isdigit() else ch for ch in body)
        return glue + "\x01" + re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", body[:4] + re.sub(r"\d", "0", body[4:20]))) + ("…" if len(body) > 20 else "")
    if len(body) > 1 and re.search(r"@|\(at\)|\[at\]| at ", body, re.I) and not head.isspace():
        style = "@" if "@" in body and " " not in body else "at"
        last = re.split(r"\.|\(dot\)|\[dot\]| dot ", body.lower())[-1].strip()
        return f"{glue}\x02{style}{'1' if any(c.isdigit() for c in last) else 'a'}"
    if len(body) > 24:
        return glue + "\x03" + ("d" if any(c.isdigit() for c in body) else "a")
    return glue + body


def _shape(word: str) -> str:
    if len(word) == 1:
        return "C" if word.isupper() else "c"
    if word.isupper():
        return "XX"
    if word[0].isupper():
        return "Xx" if word[1:].islower() else "XxX"
    return "xx" if word.islower() else "xX"


class Model:
    """Weights of the field, and the features they belong to."""

    def __init__(self, lexicon: dict[str, int], features: dict[str, int], weights: np.ndarray, pairs: np.ndarray, moves: np.ndarray, edges: np.ndarray):
        self.lexicon, self.features, self.weights = lexicon, features, weights  # weights: features x (2*REACH+1)*N
        self.pairs, self.moves, self.edges = pairs, moves, edges  # pairs: 4 x classes x classes x N, with the tokens at -1, +1, -2 and +2


CLASSES = 40


def describe(key: str, lexicon: dict[str, int]) -> tuple[list[str], int]:
    """Features and class of a token type; the lexicon has 1 given, 2 family, 3 both, plus 4 per language."""
    glue = key[:1] != " "
    body = key if glue else key[1:]
    g = "+" if glue else "_"
    if body == BREAK:
        return ["break"], 1
    mark = body[0]
    if mark == "\x01":
        raw = body[1:]
        mask = re.sub(r"\d", "0", raw)
        count = sum(c.isdigit() for c in raw)
        lead = re.sub(r"\D", "", raw[:4])
        out = ["num", "m=" + mask, f"n={count}", "l1=" + lead[:1], "l2=" + lead[:2], "l3=" + lead[:3], f"ml={mask}{lead[:1]}", f"nl={count}/{lead[:2]}", f"nl3={count}/{lead[:3]}", "g" + g]
        out.append("seps=" + "".join(sorted(set(re.sub(r"[0A-Za-z]", "", mask)))))
        if raw[-1:].isalpha():
            out.append("tail=" + ("A" if raw[-1].isupper() else "a"))
        return out, 2 + (0 if count <= 3 else 1 if count == 4 else 2 if count == 5 else 3 if count <= 6 else 4)
    if mark == "\x02":
        return ["mail", "mail=" + body[1:], "g" + g], 7
    if mark == "\x04":
        return ["mixed", "mixed=" + body[1:], "g" + g, f"n={len(body) - 1}"], 6
    if mark == "\x03":
        return ["long", "long=" + body[1:]], 8
    if not mark.isalpha():
        return ["sym", "w=" + body, "w" + g + body], 9 + {".": 0, ",": 1, "-": 2, ":": 3}.get(body, 4)
    low = unicodedata.normalize("NFC", body).lower()
    fold = _fold(body)
    lex = lexicon.get(fold, 0)
    s = _shape(body)
    tongue, lex = divmod(lex, 4)
    out = ["word", f"t={tongue}/{lex}", "w=" + low, "s=" + s, f"x={lex}", f"xs={lex}{s}", "p3=" + fold[:3], "p4=" + fold[:4], "s3=" + fold[-3:], "s4=" + fold[-4:], "s5=" + fold[-5:], f"k={min(len(low), 9)}", "g" + g]
    if fold in _TITLE_WORDS:
        return [*out, "title"], 14
    if fold in _PARTICLE_WORDS:
        return [*out, "particle"], 15
    if s == "C":
        return [*out, "initial"], 16
    kind = {"Xx": 0, "XxX": 0, "XX": 1}.get(s, 2)
    return out, 17 + 3 * lex + kind


class Tagger:
    """Decodes texts with a model; keeps one table row per token type met."""

    MOST_TYPES = 250_000

    def __init__(self, model: Model):
        self.m = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.raw: dict[str, int] = {}
        self.rows = np.zeros((1024, (2 * REACH + 1) * N), np.float32)
        self.klass = np.zeros(1024, np.int64)
        self.ids["\x00"] = 0  # stands between texts

    def _new(self, key: str) -> int:
        n = len(self.ids)
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.klass = np.concatenate([self.klass, np.zeros_like(self.klass)])
        names, klass = describe(key, self.m.lexicon)
        known = [f for x in names if (f := self.m.features.get(x)) is not None]
        if known:
            self.rows[n] = self.m.weights[known].sum(0)
        self.klass[n] = klass
        self.ids[key] = n
        return n

    def type_of(self, token: str) -> int:
        found = self.raw.get(token)
        if found is None:
            key = normal(token)
            found = self.ids.get(key)
            if found is None:
                found = self._new(key)
            self.raw[token] = found
        return found

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of every label at every token; texts must be ``REACH`` fillers apart."""
        n = len(ids)
        rows = self.rows[ids]
        em = np.zeros((n, N), np.float32)
        for k, o in enumerate(range(-REACH, REACH + 1)):
            part = rows[:, k * N : (k + 1) * N]
            if o < 0:
                em[-o:] += part[:o]
            elif o > 0:
                em[:-o] += part[o:]
            else:
                em += part
        c = self.klass[ids]
        em[1:] += self.m.pairs[0][c[:-1], c[1:]]
        em[:-1] += self.m.pairs[1][c[:-1], c[1:]]
        em[2:] += self.m.pairs[2][c[:-2], c[2:]]
        em[:-2] += self.m.pairs[3][c[:-2], c[2:]]
        fill = (ids == 0) | (c == 1)
        em[fill, 1:] = -1e4
        return em

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """The best labels of concatenated texts."""
        em = self.emissions(ids)
        moves = self.m.moves
        out = np.zeros(len(ids), np.int8)
        gain = em[:, 1:].max(1) - em[:, 0]
        # what a move can gain over staying with O, in and between items
        base = moves[0, 0]
        enter = max(0.0, float((moves[0, 1:] - base).max()))
        bonus = max(0.0, float((moves[1:, :] - base).max()))
        bound = (gain + bonus).astype(np.float64)

        def alive(x: np.ndarray) -> np.ndarray:
            c = np.cumsum(x)
            low = np.minimum.accumulate(np.concatenate([[0.0], c]))[:-1]
            return c - np.minimum(low, c)

        x = np.where(bound < -1e3, -1e3, bound)
        # the best item that could contain a token: the best run up to it, itself, the best run behind it
        ahead, back = alive(x), alive(x[::-1])[::-1]
        hot = np.concatenate([[0.0], ahead[:-1]]) + x + np.concatenate([back[1:], [0.0]]) + enter > 0
        if not hot.any():
            return out
        edge = np.diff(np.concatenate([[0], hot.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - begin
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 2048):
            own = order[at : at + 2048]
            b, s = begin[own], size[own]
            steps = int(s.max())
            back_ptr = np.zeros((steps, len(own), N), np.int8)
            score = em[b] + moves[0][None, :]
            for t in range(1, steps):
                live = np.flatnonzero(s > t)
                cand = score[live][:, :, None] + moves[None, :, :]
                best = cand.argmax(1)
                back_ptr[t, live] = best
                score[live] = np.take_along_axis(cand, best[:, None, :], 1)[:, 0, :] + em[b[live] + t]
            last = (score + moves[:, 0][None, :]).argmax(1)
            for t in range(steps - 1, -1, -1):
                live = np.flatnonzero(s > t)
                out[b[live] + t] = last[live]
                if t:
                    last[live] = back_ptr[t, live, last[live]]
        return out

    def items(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """For every text its items as (kind, start, end), 0-based, in code points."""
        if len(self.ids) > self.MOST_TYPES or len(self.raw) > 4 * self.MOST_TYPES:
            self._reset()
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        all_tokens, ids, where = [], [0] * REACH, []
        lookup = self.raw.get
        for i, text in enumerate(texts):
            if not text:
                continue
            toks = TOKEN.findall(text)
            row = [lookup(t) for t in toks]
            if None in row:
                row = [self.type_of(t) if r is None else r for t, r in zip(toks, row)]
            where.append((i, len(ids)))
            all_tokens.append(toks)
            ids += row
            ids += [0] * REACH
        if not where:
            return found
        labels = self.labels(np.array(ids, np.int64))
        at = np.array([w for _, w in where])
        sizes = np.array([len(t) for t in all_tokens])
        inside = np.flatnonzero(labels)
        touched = np.unique(np.searchsorted(at, inside, side="right") - 1)
        for k in touched:
            lab = labels[at[k] : at[k] + sizes[k]]
            i = where[k][0]
            found[i] = _spans(all_tokens[k], lab.tolist(), self.m.lexicon)
        return found


_NAME_PART = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")


def _spans(tokens: list[str], labels: list[int], lexicon: dict[str, int]) -> list[tuple[str, int, int]]:
    """Items of one text: runs of begin and inside labels, checked against the definition of a name."""
    out: list[tuple[str, int, int]] = []
    pos = k = after = 0
    starts = []
    for t in tokens:
        starts.append(pos)
        pos += len(t)
    while k < len(tokens):
        lab = labels[k]
        if lab == 0:
            k += 1
            continue
        j = k + 1
        if lab >= 4:
            inside = 5 if lab in (4, 5) else 7
            while j < len(tokens) and labels[j] == inside:
                j += 1
        a, b = k, j
        kind = KIND[lab]
        if kind == "name":
            while a < b and _fold(tokens[a].strip().rstrip(".")) in _TITLE_WORDS and a + 1 < b:
                a += 1
                if tokens[a].strip() == "." and a + 1 < b:
                    a += 1
            stops = [i for i in range(a + 1, b - 1) if tokens[i] == "." and len(tokens[i - 1].strip()) > 4]
            if stops:  # a full stop behind a long word ends a sentence
                a = stops[-1] + 1
            if b - a == 3 and tokens[a + 1] == ".":  # a letter that is a title in the family name's language
                tongue = lexicon.get(_fold(tokens[a + 2].strip()), 0) // 4
                if (tokens[a].strip(), tongue) in (("M", 3), ("D", 4)):
                    a += 2
        while b > a + 1 and not tokens[b - 1].strip()[-1:].isalnum() and not (kind in ("name", "address") and tokens[b - 1].strip() == "."):
            b -= 1
        if _HOLDS[kind](tokens, a, b):
            lead = len(tokens[a]) - len(tokens[a].lstrip())
            begin, end = starts[a] + lead, starts[b - 1] + len(tokens[b - 1])
            joined = out and kind == "address" and out[-1][0] == kind and not "".join(tokens[after:a]).strip(" \t\r\n,")
            if joined and sum(t.count("\n") for t in tokens[after:a]) < 2:
                out[-1] = (kind, out[-1][1], end)  # the town on the line below the street
            elif kind != "address" or _has_street(tokens, a, b):
                out.append((kind, begin, end))
            after = b
        k = j
    return out


#: Endings of street names that stand before their number.
STREET_END = ("strasse", "str", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "hof", "markt", "steig", "pfad", "chaussee", "wall", "tor", "berg", "feld", "garten")
_POSTCODE = re.compile(r"\d{5}")


def _is_address(tokens: list[str], a: int, b: int) -> bool:
    """A number and a word."""
    words = [t.strip() for t in tokens[a:b]]
    cells = any(t[:1] == "\t" or t[:2] == "  " for t in tokens[a + 1 : b])
    return any(w[:1].isdigit() for w in words) and any(w[:1].isalpha() and len(w) > 2 for w in words) and "|" not in words and not cells


def _has_street(tokens: list[str], a: int, b: int) -> bool:
    """A single word with a number behind it is a street only by its ending; a postcode makes none."""
    words = [t.strip() for t in tokens[a:b]]
    if _POSTCODE.fullmatch(words[0]):
        return False
    first = next((i for i, w in enumerate(words) if w[:1].isdigit()), len(words))
    names = [w for w in words[:first] if w[:1].isalpha()]
    if first and len(names) == 1:
        return _fold(names[0]).endswith(STREET_END)
    return True


def _is_mailbox(tokens: list[str], a: int, b: int) -> bool:
    return _MAILBOX.fullmatch(tokens[a].strip()) is not None


def _is_number(tokens: list[str], a: int, b: int) -> bool:
    body = "".join(tokens[a:b])
    return sum(c.isdigit() for c in body) >= 6


def _is_name(tokens: list[str], a: int, b: int) -> bool:
    """Two name parts (particles don't count), or one with a title before it."""
    words = [t.strip() for t in tokens[a:b]]
    if any(tokens[i] == "," and not tokens[i + 1][0].isspace() for i in range(a, b - 1)):  # cells of a row
        return False
    if any(len(w) == 1 and not w.isalnum() and w not in ".,-'’" for w in words):  # other marks are in no name
        return False
    parts = [w for w in words if _NAME_PART.fullmatch(w) and _fold(w) not in _PARTICLE_WORDS]
    if not any(len(w) > 2 for w in parts):  # initials alone are none
        return False
    joined = any(w == "-" for w in words)
    if len(parts) - (1 if joined and len(parts) == 2 else 0) >= 2:
        return True
    before = [t.strip() for t in tokens[max(0, a - 2) : a]]
    return any(_fold(w.rstrip(".")) in _TITLES for w in before)


_HOLDS = {"name": _is_name, "address": _is_address, "email": _is_mailbox, "phone": _is_number, "id_number": lambda t, a, b: _is_number(t, a, b) or len(t[a].strip()) >= 7}


def _align(row: list[tuple[str, str | None]]) -> tuple[list[str], list[int]]:
    """Tokens and labels of one labelled row."""
    text = "".join(t for t, _ in row)
    mark = np.zeros(len(text), np.int64)
    pos = 0
    for n, (t, kind) in enumerate(row):
        if kind:
            mark[pos : pos + len(t)] = 1 + n
        pos += len(t)
    kinds = {1 + n: kind for n, (_, kind) in enumerate(row)}
    toks, labels, pos, before = tokens_of(text), [], 0, 0
    for t in toks:
        lead = len(t) - len(t.lstrip())
        inner = mark[pos + lead : pos + len(t)]
        own = int(inner[0]) if len(inner) else 0
        kind = kinds.get(own)
        if kind is None:
            labels.append(0)
        elif kind in ("address", "name"):
            labels.append((4 if kind == "address" else 6) + (own == before))
        else:
            labels.append(LABELS.index(kind))
        before = own
        pos += len(t)
    return toks, labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def train(words: tuple[tuple[str, str, str], ...], rows: int = ROWS, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit the field on ``rows`` labelled rows; ``words`` is the lexicon as (word, type, language)."""
    by_lang: dict[str, tuple[list[str], list[str]]] = {}
    for w, kind, lang in words:
        by_lang.setdefault(lang, ([], []))[0 if kind == "given" else 1].append(w)
    lexicon: dict[str, int] = {}
    for w, kind, lang in words:
        tongue = 4 * (1 + ("en", "de", "fr", "es").index(lang)) if lang in ("en", "de", "fr", "es") else 0
        lexicon[_fold(w)] = tongue + (lexicon.get(_fold(w), 0) % 4 | (1 if kind == "given" else 2))
    rng = np.random.default_rng(seed)
    features: dict[str, int] = {}
    types: dict[tuple[str, bool], int] = {}
    of_type: list[np.ndarray] = []
    class_of: list[int] = []
    seqs = []
    for toks, labels in (_align(r) for r in Writer(by_lang).rows(rows)):
        own = []
        for t, lab in zip(toks, labels):
            # part of the names are hidden from the lexicon, as part of the text's names are
            key = normal(t), bool(lab >= 6 and rng.random() < HIDDEN)
            if key not in types:
                names, c = describe(key[0], {} if key[1] else lexicon)
                types[key] = len(types)
                of_type.append(np.array([features.setdefault(x, len(features)) for x in names]))
                class_of.append(c)
            own.append(types[key])
        seqs.append((np.array(own), np.array(labels)))
    classes = np.array(class_of)
    width = (2 * REACH + 1) * N
    params = [np.zeros((len(features), width), np.float32), np.zeros((4, CLASSES, CLASSES, N), np.float32), np.zeros((N, N), np.float32)]
    first, second, mean = ([np.zeros_like(p) for p in params] for _ in range(3))
    order = np.argsort([len(s[0]) for s in seqs], kind="stable")
    batches = [order[k : k + 96] for k in range(0, len(order), 96)]
    step = 0
    forbid = np.zeros((N, N), np.float32)
    for y in (5, 7):
        for x in range(N):
            if x not in (y, y - 1):
                forbid[x, y] = -1e4
    for epoch in range(epochs):
        rate = 0.06 * (1 - epoch / epochs) + 0.003
        for which in rng.permutation(len(batches)):
            own = [seqs[i] for i in batches[which]]
            size = np.array([len(s[0]) for s in own])
            T, B = int(size.max()), len(own)
            used_types, of_token = np.unique(np.concatenate([s[0] for s in own]), return_inverse=True)
            parts = [of_type[k] for k in used_types]
            counts = np.array([len(f) for f in parts])
            flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), counts)
            seq = np.repeat(np.arange(B), size)
            place = np.concatenate([np.arange(n) for n in size])
            rowsum = np.add.reduceat(params[0][flat], np.cumsum(counts) - counts, axis=0)[of_token]
            em = np.zeros((B, T, N), np.float32)
            shifts = []
            for k, o in enumerate(range(-REACH, REACH + 1)):
                to = place - o
                ok = np.flatnonzero((to >= 0) & (to < size[seq]))
                shifts.append((ok, seq[ok], to[ok]))
                em[seq[ok], to[ok]] += rowsum[ok, k * N : (k + 1) * N]
            klass, gold = np.zeros((B, T), np.int64), np.zeros((B, T), np.int64)
            klass[seq, place] = classes[used_types][of_token]
            gold[seq, place] = np.concatenate([s[1] for s in own])
            at, live = np.arange(T)[None, :], np.arange(T)[None, :] < size[:, None]
            near = {k: np.where((at >= k) & (at < size[:, None] + k), np.roll(klass, k, 1), 0) for k in (1, 2, -1, -2)}
            around = ((near[1], klass), (klass, near[-1]), (near[2], klass), (klass, near[-2]))
            for table, (x, y) in zip(params[1], around):
                em += table[x, y]
            move = params[2] + forbid
            a = np.zeros((B, T, N), np.float32)
            a[:, 0] = em[:, 0] + move[0]
            for t in range(1, T):
                a[:, t] = np.where(live[:, t, None], _logsum(a[:, t - 1, :, None] + move[None], 1) + em[:, t], a[:, t - 1])
            z = _logsum(a[:, T - 1] + move[:, 0], 1)
            b = np.zeros((B, T, N), np.float32)
            b[:, T - 1] = move[:, 0]
            for t in range(T - 2, -1, -1):
                nxt_b = _logsum(move[None] + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                b[:, t] = np.where(live[:, t + 1, None], nxt_b, move[:, 0])
            diff = np.exp(a + b - z[:, None, None]) * live[..., None]
            bi, ti = np.nonzero(live)
            diff[bi, ti, gold[bi, ti]] -= 1
            grad_rows = np.zeros_like(rowsum)
            for k, (ok, s_ok, t_ok) in enumerate(shifts):
                grad_rows[ok, k * N : (k + 1) * N] = diff[s_ok, t_ok]
            by = np.argsort(of_token, kind="stable")
            by_type = np.add.reduceat(grad_rows[by], np.searchsorted(of_token[by], np.arange(len(parts))), axis=0)
            by = np.argsort(flat, kind="stable")
            used, first_at = np.unique(flat[by], return_index=True)
            g0 = np.add.reduceat(by_type[owner[by]], first_at, axis=0)
            g1 = np.zeros_like(params[1])
            for table, (x, y) in zip(g1, around):
                cell = x[live] * CLASSES + y[live]
                for n in range(N):
                    table[:, :, n] = np.bincount(cell, diff[live][:, n], CLASSES * CLASSES).reshape(CLASSES, CLASSES)
            g2 = np.zeros_like(params[2])
            if T > 1:
                both = a[:, :-1, :, None] + move[None, None] + (em[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
                g2 += (np.exp(both) * live[:, 1:, None, None]).sum((0, 1))
                ok = live[:, 1:]
                np.add.at(g2, (gold[:, :-1][ok], gold[:, 1:][ok]), -1)
            step += 1
            for k, g in enumerate((g0, g1, g2)):
                at_k = used if k == 0 else slice(None)  # features that the batch doesn't have keep their weights
                p, m1, m2 = params[k][at_k], first[k][at_k], second[k][at_k]
                g = g / B + 6e-4 * p
                m1 = 0.9 * m1 + 0.1 * g
                m2 = 0.99 * m2 + 0.01 * g * g
                first[k][at_k], second[k][at_k] = m1, m2
                params[k][at_k] = p - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        if epoch >= epochs - LAST:  # the mean over the last epochs varies less than the last one
            for m, p in zip(mean, params):
                m += p / LAST
    moves = mean[2] + forbid
    return Model(lexicon, features, mean[0], mean[1], moves, moves[0])


def _digest(words: tuple[tuple[str, str, str], ...]) -> str:
    """What a trained model depends on: the labelled table, how it is drawn, the features and the lexicon."""
    from lorefield.llm import pii_examples

    code = "".join(inspect.getsource(x) for x in (pii_examples, train, describe, normal, _align))
    return hashlib.sha256(repr((words, ROWS, EPOCHS, LAST, HIDDEN, REACH, TOKEN.pattern, code)).encode()).hexdigest()[:32]


_MODELS: dict[str, Model] = {}


def model_for(words: tuple[tuple[str, str, str], ...], spark: SparkSession | None = None) -> Model:
    """The model of a lexicon: of this process, else the one stored in the shared folder, else trained and stored there."""
    key = _digest(words)
    if key not in _MODELS:
        path = f"{checkpoint_dir(spark).rstrip('/')}/lorefield-models/{key}" if spark else None
        stored = None
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                stored = spark.read.schema("model binary").parquet(path).first()
        if stored is None:
            model = train(words, ROWS, EPOCHS)
            if path:
                spark.createDataFrame([(bytearray(pickle.dumps(model, protocol=5)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
        _MODELS[key] = model if stored is None else pickle.loads(stored["model"])
    return _MODELS[key]


#: The lexicon comes to the driver, as the model's features name its words; a larger table is no lexicon.
MOST_WORDS = 200_000


def lexicon_of(names: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """The lexicon as a tuple: a fixed table of some hundred words. One of over ``MOST_WORDS`` is refused."""
    rows = names.filter("word is not null and word_type in ('given', 'family')").select("word", "word_type", F.coalesce("lang", F.lit("en")).alias("lang")).distinct()
    found = rows.limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"the name lexicon has over {MOST_WORDS} words")
    return tuple(sorted((r["word"], r["word_type"], r["lang"]) for r in found))


_TAGGERS: dict[int, Tagger] = {}


def _tagger(shared) -> Tagger:
    """One tagger per worker process and model, kept across batches and tasks."""
    if shared.id not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[shared.id] = Tagger(shared.value)
    return _TAGGERS[shared.id]


class _Shared:
    """A broadcast model with an identity that survives pickling."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> Model:
        return self.broadcast.value


def _finder(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for at in range(0, len(texts), 512):
                own = tagger.items(texts[at : at + 512])
                rows = [(i, kind, a + 1, b - a) for i, items in zip(ids[at : at + 512], own) for kind, a, b in items]
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["id", "kind", "start_pos", "length"])

    return run


def redact(text: str, items: list[tuple[str, int, int]]) -> str:
    """``text`` with every item replaced by its kind in square brackets."""
    out, at = [], 0
    for kind, a, b in sorted(items, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def _redactor(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[str | None] = []
            for at in range(0, len(texts), 512):
                own = texts[at : at + 512]
                out += [x if x is None else redact(x, i) for x, i in zip(own, tagger.items(own))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return run


def _share(rows: DataFrame, words: tuple[tuple[str, str, str], ...]) -> _Shared:
    # a few MB, bounded by ROWS labelled rows
    spark = rows.sparkSession
    return _Shared(spark.sparkContext.broadcast(model_for(words, spark)), hash(words) & 0x7FFFFFFF)


def _slim(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def find_items(rows: DataFrame, id_col: str, text_col: str, words: tuple[tuple[str, str, str], ...], src: str) -> DataFrame:
    """(src, rec_id, kind, start_pos, length) of every item; start_pos is 1-based, in code points.

    A narrow operation; the final ``distinct`` is over the few items found, not over the texts.
    """
    slim = _slim(rows, id_col, text_col).filter(F.length("text") > 0)
    out = slim.mapInArrow(_finder(_share(rows, words)), "id long, kind string, start_pos long, length long").distinct()
    return out.select(F.lit(src).alias("src"), F.col("id").alias("rec_id"), "kind", "start_pos", "length")


def redacted(rows: DataFrame, id_col: str, text_col: str, words: tuple[tuple[str, str, str], ...], src: str) -> DataFrame:
    """(src, rec_id, text) with typed placeholders in place of the items; one row per row."""
    out = _slim(rows, id_col, text_col).mapInArrow(_redactor(_share(rows, words)), "id long, text string")
    return out.select(F.lit(src).alias("src"), F.col("id").alias("rec_id"), "text")
