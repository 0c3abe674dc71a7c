"""p8: each of the three structural signals decides kinds of its own; what looks alike without them stays prose."""

import numpy as np
import pytest

from lorefield.llm import quality
from lorefield.llm.quality import autocorrelations, kind_of, kinds_of, recurrence

ENTRIES = ["plans for the northern harbour and its older piers", "survey of the eastern wall with drawings and notes", "costs of timber and stone delivered by the river", "names of the masons who worked there in the spring", "letters from the council about the second bridge", "minutes of the meetings held in the upper chamber", "a list of all gates that were closed after the flood", "reports about the grain that was kept over winter", "the orders given to the guard of the lower market", "drawings of a mill that nobody has built so far", "accounts of the toll at both ends of the bridge", "what the clerks wrote on the margins of the maps"]
OUTLINE = "\n".join(" " * n + x for n, x in zip([0, 2, 4] * 4, ENTRIES))
CARDS = "\n".join(f"{x}, volume {k + 10}\nshelf {k}" for k, x in enumerate(ENTRIES))
GRID = "name;place;year\n" + "\n".join(f"the {w} house;{w}bury;18{k + 10}" for k, w in enumerate("old new red blue long".split()))


def test_unmarked_outline_is_a_list():
    for indents in ([0, 2, 4] * 4, [0, 2, 2, 4, 0, 2, 4, 4, 0, 2, 4, 0], [0, 4] * 6):
        assert kind_of("\n".join(" " * n + x for n, x in zip(indents, ENTRIES))) == "list"
    assert kind_of("\n".join(ENTRIES)) == "prose"


def test_indented_paragraphs_stay_prose():
    text = """   When the boats came back the men carried the nets up
the hill and hung them on the poles behind the church where
the wind was strong enough to dry them before the evening
and the children sorted what the water had left in them.
   My father never learned to swim although he had spent
more than forty years on that coast and he always told us
how little it would have helped him in the cold of January
if the mast had gone over the side as it did in his youth.
   Some of the houses near the quay are empty now because
nobody wants to climb the stairs that the winter has broken
or pay for a roof which the next storm will take again with
everything that was kept dry under it for so many summers."""
    assert kind_of(text) == "prose"


@pytest.mark.parametrize("text, kind, signal", [(OUTLINE, "list", 6), (CARDS, "list", 5), (GRID, "table", None)])
def test_each_signal_decides(monkeypatch, text, kind, signal):
    assert kind_of(text) == kind
    if signal is None:
        monkeypatch.setattr(quality, "_alike", lambda counts, doc: np.zeros(len(counts), bool))
    else:
        monkeypatch.setattr(quality, "ENTRY", np.where(np.arange(7) == signal, 0.0, quality.ENTRY))
    assert kind_of(text) != kind


def test_autocorrelation_is_that_of_each_text():
    values, doc = np.array([0, 2, 4] * 5 + [7.0] * 6), np.array([0] * 15 + [1] * 6)
    got = autocorrelations(values, doc, 2)
    plain = values[:15] - values[:15].mean()
    for lag in range(1, 7):
        assert got[lag - 1, 0] == pytest.approx((plain[lag:] * plain[:-lag]).sum() * 15 / (15 - lag) / (plain**2).sum())
    assert not got[:, 1].any() and recurrence(values, doc, 2)[0] == pytest.approx(1.0)


def test_a_batch_is_read_like_its_texts():
    texts = [OUTLINE, "", CARDS.replace("\n", "\r\n"), "  \n", GRID, "a", "- x\n- y z\r- q", "\n\n", "one line. Another one here."]
    assert kinds_of(texts).tolist() == [int(kinds_of([x])[0]) for x in texts]
