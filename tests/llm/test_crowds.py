"""Regions of the forest with many members: no pair of theirs is left out."""

import random

import pytest

from lanewise.llm import forest

from test_forest import brute, edited, found


@pytest.mark.parametrize("block", [7, 1 << 12])
def test_copies_of_copies_in_a_crowd(spark, monkeypatch, block):
    """Texts around one that are too far from it and from one another, each with a copy of its own. Without longer beginnings the forest
    itself compares none of them but with the central one; the rest does, in one block or in many."""
    monkeypatch.setattr(forest, "DEPTHS", (4,))
    monkeypatch.setattr(forest, "REGION", 3)
    monkeypatch.setattr(forest, "BLOCK", block, raising=False)
    g = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)] + [" ".join(edited(g, base, 3)) for _ in range(20)]
    for _ in range(40):
        far = edited(g, base, 22)
        texts += [" ".join(far), " ".join(edited(g, far, 3))]
    g.shuffle(texts)
    links, want = brute(list(enumerate(texts)))
    assert len(links) > 60 and found(spark, list(enumerate(texts))) == want
