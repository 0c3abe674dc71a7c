"""Splitting, encoding, leakage, quality and personal items: definitions, edge cases, brute force."""

import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefield.llm import encoding, leakage, pii, quality, splitting

have_tokenizer = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary file here")


def greedy(lengths, limit):
    """The definition, line by line."""
    out, k, n = [], 0, len(lengths)
    while k < n:
        if lengths[k] > limit:
            out.append((k, k))
            k += 1
            continue
        j, size = k, lengths[k]
        while j + 1 < n and size + 1 + lengths[j + 1] <= limit:
            j += 1
            size += 1 + lengths[j]
        out.append((k, j))
        if j + 1 >= n:
            break
        k = j if j > k and lengths[j] + 1 + lengths[j + 1] <= limit else j + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=30), st.integers(1, 40))
def test_line_pieces_match_the_definition(lengths, limit):
    import numpy as np

    assert splitting.line_pieces(np.array(lengths, dtype=np.int64), limit) == greedy(lengths, limit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r", max_size=120), st.integers(1, 20))
def test_pieces_fit_and_cover(text, limit):
    pieces = splitting.split_text(text, limit)
    assert all(e - s <= limit for _, _, s, e in pieces)
    covered = {i for _, _, s, e in pieces for i in range(s, e)}
    assert all(i in covered or text[i] == "\n" for i in range(len(text)))


def test_ranges_of_pieces(spark):
    long = "x" * 700
    rows = [(1, "10-12", f"{long}\n{long}\nend"), (1, "10-12", f"{long}\n{long}\nend"), (2, "p3:4", f"{long}\n{'y' * 1300}\nz"), (3, "1-1", "short"), (4, "1-1", None), (5, "9-9", ""), (None, "1-1", "x" * 2000), (6, "99999999999999999999-1", "w " * 900)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_range string, text string").withColumn("id", F.lit(7)).withColumn("lo", F.lit("clash"))
    got = sorted(tuple(r)[1:] for r in splitting.piece_ranges(df, "chunk_id", "chunk_range", "text", "chunk").collect())
    assert got == [(1, 10, 10), (1, 11, 12), (2, 1, 1), (2, 2, 2), (2, 3, 3), (6, 1, 1)]
    assert splitting.piece_ranges(df.limit(0), "chunk_id", "chunk_range", "text", "chunk").count() == 0
    assert splitting.pieces(df, "chunk_id", "chunk_range", "text", "chunk").filter("length(text) > 1200").count() == 0


@have_tokenizer
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'’srelv 0 1\n\t.,;-é漢😀́{}<|>", max_size=90), st.integers(1, 40))
def test_tree_encoding_equals_direct_encoding(text, leaf):
    enc = encoding.Encoder(leaf=leaf)
    assert enc.encode(text) == enc.direct(text)


@have_tokenizer
def test_encoding_round_trip_and_edges(spark):
    r = random.Random(3)
    big = " ".join("".join(r.choice("abcdefgh ,.\n") for _ in range(40)) for _ in range(600))
    df = spark.createDataFrame([(1, big), (2, ""), (3, None), (4, "<|endoftext|> x"), (None, "a")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x["ids"] for x in encoding.encode_table(df, "doc_id", "text").collect()}
    assert encoding.decode(got[1]) == big and got[2] == [] and got[3] == []
    assert 50256 not in got[4] and got[None]
    assert encoding.encode_table(df.limit(0), "doc_id", "text").count() == 0
    one = "z" * 30000
    assert encoding.decode(encoding.Encoder().encode(one)) == one


@have_tokenizer
def test_windows_grow_and_stay_small():
    """Ordinary documents go through the tree; a join encodes a few characters again, more only without a safe offset."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdeé漢") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 400))) for _ in range(40)] + ["", None, "y" * 900 + " x", "it's " * 300]
    enc = encoding.Encoder(leaf=32, window=4)
    assert enc.encode_all(texts) == [enc.direct(x or "") for x in texts]
    assert 0 < enc.joined < 2 * sum(len(x or "") for x in texts)
    words = encoding.Encoder()
    words.encode("several plain words of text, then more; " * 500)
    assert 0 < words.joined < 0.1 * 20000


WORD = re.compile(r"[^\W_]+")


def test_leaks_match_brute_force(spark):
    r = random.Random(5)
    vocab = "a b c d e f g".split()
    items = [" ".join(r.choice(vocab) for _ in range(r.randrange(4, 20))) for _ in range(12)]
    docs = []
    for k in range(60):
        words = [r.choice(vocab) + "x" for _ in range(r.randrange(0, 12))]
        src = items[r.randrange(12)].split()
        a = r.randrange(len(src))
        docs.append(" ".join(words[:4] + src[a : a + r.randrange(1, 14)] + words[4:]))
    want = set()
    for i, d in enumerate(docs):
        w = WORD.findall(d)
        grams = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        want |= {(i, j) for j, x in enumerate(items) if grams & {tuple(x.split()[k : k + 8]) for k in range(len(x.split()) - 7)}}
    c = spark.createDataFrame(list(enumerate(docs)) + [(900, None), (901, ""), (None, items[0])], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    i = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "a b")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    c, i = c.unionByName(c), i.unionByName(i)
    got = leakage.leaks(c, i)
    assert {(x["doc_id"], x["item_id"]) for x in got.filter("exact >= 8").collect()} == want
    assert got.count() == got.select("doc_id", "item_id").distinct().count()
    assert leakage.leaks(c.limit(0), i).count() == 0 and leakage.leaks(c, i.limit(0)).count() == 0
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(leakage.leaks(c, i, most_chars=100)) == key(got)  # a test side in several blocks


def test_leaks_tolerate_a_replaced_word(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    doc = item.replace("six", "SIXTH")
    c, i = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    r = leakage.leaks(c, i).first()
    assert r["exact"] == 6 and r["tolerant"] == 12


def test_every_tolerant_passage_is_found():
    """Planted passages with one and two replaced words, in every place the definition tolerates: none is lost."""
    words = [f"w{k}" for k in range(12)]
    for size in (8, 10, 12):
        side = leakage.TestSide([7], [" ".join(words[:size])])
        places = [(i,) for i in range(1, size - 1)] + [(i, j) for i in range(1, size) for j in range(i + leakage.APART + 1, size - 1)]
        texts = ["before " + " ".join("other" if k in own else w for k, w in enumerate(words[:size])) + " behind" for own in places]
        got = {t: (exact, far) for t, item, exact, far in side.search(texts) if item == 7}
        for t, own in enumerate(places):
            runs = [b - a - 1 for a, b in zip((-1, *own), (*own, size))]
            if all(r >= leakage.APART for r in runs[:-1]):  # else the stretch before a difference is too short to be bridged
                assert got[t] == (max(runs), size)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The first note was late. It isn't the second one that waits for the archive, which we have moved.", "prose"),
        ("- one\n- two things\n- three", "list"),
        ("@status: open\n@due: 2026-01-01\n@topic: x", "list"),
        ("Larkvault\nTarnwell\nthe frozen note\nMossgate\nQuillridge", "list"),
        ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "table"),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"),
        ("name      size   n\nfirst     10     1\nsecond    200    2\nthird     3      9", "table"),
        ("2026-01-01T10:00:00Z ERROR x[1]: a=1\n2026-01-01T10:00:01Z INFO y[2]: b=2", "junk"),
        ("loading…\n" * 12, "junk"),
        ("}{><#%^&*()_+=-~`|\\][;:/?.,}{><#%^&*()", "junk"),
        ("gate lark gate moss lark gate moss moss lark gate lark moss gate", "junk"),
        ("ardOU24klBpAzjLt34EiravztXnA33mH9yneDEdj3NqWz56EAuq7GWoRIDNnQ9xyqypx", "junk"),
        ("", None),
        ("  \n\t", None),
        (None, None),
    ],
)
def test_kinds_of_text(text, kind):
    assert quality.kind_of(text) == kind


def test_statistics_columns(spark):
    df = spark.createDataFrame([(1, "A b. C d!\n- x"), (1, "A b. C d!\n- x"), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    rows = quality.text_statistics(df, "doc_id", "text").collect()
    assert len(rows) == 4 and all(r[n] is not None for r in rows for n in quality.STATISTICS)
    assert {tuple(r) for r in quality.text_kinds(df, "doc_id", "text").collect()} == {(1, "prose")} or quality.text_kinds(df, "doc_id", "text").count() == 1
    assert quality.text_kinds(df.limit(0), "doc_id", "text").count() == 0


LEXICON = tuple(
    [(w, "given", "en") for w in "Edith Grant Rose Nigel Iris Stuart Howard Fergus Percy Brian Olive Clara".split()]
    + [(a + b, "family", "en") for a in "Mardle Caldi Penn Thorn Wex Skel Orm Hather".split() for b in "wick croft stow ley mere dale burrow".split()]
    + [(w, "given", "de") for w in "Volker Gesine Hartmut Ulrike".split()]
    + [(a + b, "family", "de") for a in "Holt Brinken Krumm Rhein Lüne".split() for b in "hoff brandt lohe sieken".split()]
    + [(w, "given", "fr") for w in "Irène Pascal Yvon".split()]
    + [(a + b, "family", "fr") for a in "Mont Beau Haute Grand".split() for b in "rency vigne nel lliot".split()]
    + [(w, "given", "es") for w in "Óscar Nieves Mateo".split()]
    + [(a + b, "family", "es") for a in "Fuente Quint Valde Sol".split() for b in "riz zaga mbres alba".split()]
)


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.model_for(LEXICON))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Contact: mailto:edith+notes@mx.larkgate.example soon", [("email", "edith+notes@mx.larkgate.example")]),
        ("Forwarded from olive dot pennwick at fengate dot example about it.", [("email", "olive dot pennwick at fengate dot example")]),
        ("Call +44 20 7946 0178 twice in a row.", [("phone", "+44 20 7946 0178")]),
        ("Phone: (206) 555-0137", [("phone", "(206) 555-0137")]),
        ("The form lists SSN 912-34-5678 for Larkgate.", [("id_number", "912-34-5678")]),
        ("Shelf mark 912-34-5678 is in Larkgate.", []),
        ("ISBN 978-0-1089-6753-6 sits on the shelf.", []),
        ("npm i @larkgate/loom@6.57", []),
        ("Pull from git@larkgate:notes.git after a restart.", []),
        ("We meet at 44 Tanner Road, Saltreach", [("address", "44 Tanner Road, Saltreach")]),
        ("Neue Anschrift: Birkengasse 15", [("address", "Birkengasse 15")]),
        ("Signed off by Clara Thornwick.", [("name", "Clara Thornwick")]),
        ("cc Ms Pennmere on Larkgate", [("name", "Pennmere")]),
        ("I met Edith in plain view.", []),
        ("", []),
        (None, []),
    ],
)
def test_items(tagger, text, want):
    got = tagger.items([text])[0]
    assert [(k, text[a:b]) for k, a, b in got] == want


def test_held_out_accuracy(tagger):
    """On sentences by another hand, which training never draws from."""
    by: dict = {}
    for w, kind, lang in LEXICON:
        by.setdefault(lang, ([], []))[0 if kind == "given" else 1].append(w)
    right = wrong = missed = 0
    for row in pii.Writer(by, seed=77).rows(400, held_out=True):
        text = "".join(t for t, _ in row)
        pos, gold = 0, set()
        for t, kind in row:
            if kind:
                gold.add((kind, pos))
            pos += len(t)
        got = {(k, a) for k, a, _ in tagger.items([text])[0]}
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.8 and right / (right + missed) > 0.85


def test_training_sentences_are_not_the_held_out_ones():
    from lorefield.llm import pii_examples as X

    trained = {line for table in (X.NAMED, X.CONTACT, X.PLAIN) for text in table.values() for line in text.split("\n")} - {"{S} {S}"}
    assert not trained & {line for lines in X.HELD_OUT.values() for line in lines}


def test_a_stored_model_is_read_back(spark, monkeypatch):
    words = LEXICON[:40]
    monkeypatch.setattr(pii, "ROWS", 40)
    monkeypatch.setattr(pii, "EPOCHS", 3)
    key = pii._digest(words)
    monkeypatch.setattr(pii, "_digest", lambda words: key)
    first = pii.model_for(words, spark)
    monkeypatch.setattr(pii, "_MODELS", {})
    monkeypatch.setattr(pii, "train", None)  # training again would fail
    again = pii.model_for(words, spark)
    assert (again.weights == first.weights).all() and again.features == first.features


def test_names_of_any_length_count():
    tokens = pii.tokens_of("Ana María del Carmen Luisa Isabel Teresa Pilar Sofía de los Fuentes y Quintana")
    assert pii._is_name(tokens, 0, len(tokens))
    assert not pii._is_name(pii.tokens_of("Anna | Berg"), 0, 3)


def test_pruning_equals_whole_viterbi(tagger):
    """Windows of the pruned decoder against Viterbi over every token."""
    import numpy as np

    by: dict = {}
    for w, kind, lang in LEXICON:
        by.setdefault(lang, ([], []))[0 if kind == "given" else 1].append(w)
    for row in pii.Writer(by, seed=3).rows(60):
        toks = pii.tokens_of("".join(t for t, _ in row))
        ids = np.array([0] * pii.REACH + [tagger.type_of(t) for t in toks] + [0] * pii.REACH)
        em, moves = tagger.emissions(ids), tagger.m.moves
        score, back = em[0] + moves[0], []
        for e in em[1:]:
            cand = score[:, None] + moves
            back.append(cand.argmax(0))
            score = cand.max(0) + e
        path = [int((score + moves[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert tagger.labels(ids).tolist() == path[::-1]


def test_tokens_tile_the_text():
    for text in ("a  b\n\n c\t@x: y z", "é́ 😀\r\n", "  ", "\n"):
        assert "".join(pii.tokens_of(text)) == text


def test_finding_and_redacting(spark):
    rows = [(1, "Phone: 020 7946 0403\nSigned off by Clara Thornwick."), (1, "Phone: 020 7946 0403\nSigned off by Clara Thornwick."), (2, None), (3, ""), (None, "Phone: 020 7946 0403"), (4, "x " * 50_000 + "Phone: 020 7946 0403")]
    df = spark.createDataFrame(rows, "message_id long, content string").withColumn("kind", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {(r["rec_id"], r["kind"], r["start_pos"]) for r in pii.find_items(df, "message_id", "content", LEXICON, "message").collect()}
    assert got == {(1, "phone", 8), (1, "name", 36), (4, "phone", 100_008)}
    red = {r["rec_id"]: r["text"] for r in pii.redacted(df, "message_id", "content", LEXICON, "message").collect()}
    assert red[1] == "Phone: [PHONE]\nSigned off by [NAME]." and red[2] is None and red[3] == ""
    assert pii.find_items(df.limit(0), "message_id", "content", LEXICON, "m").count() == 0
