import itertools
import random

import corpus_pipeline
import pytest

from lanewise.llm import copies, forest

SCHEMA = "doc_id long, text string"


def brute_shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(texts):
    """Sets of positions that links of similarity 0.8 or equal words connect."""
    s, root = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if s[a] == s[b] or (s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return {frozenset(k for k in range(len(root)) if root[k] == r) for r in root}


def planted():
    """Texts of 120 words, each with copies that change one to four words, and texts that share half of theirs."""
    g = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        base = [g.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4):
            other = list(base)
            for k in g.sample(range(120), n):
                other[k] = g.choice(words)
            texts.append(" ".join(other).title() if n == 2 else " ".join(other))
        texts.append(" ".join(base[:60] + [g.choice(words) for _ in range(60)]))
    return [*texts, "", None, "a b", "A  b", "a c"]


def test_stage_drops_planted_near_copies(spark):
    texts = planted()
    want = brute_groups(texts)
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA), "").collect()
    at = [next(g for g in want if r["doc_id"] in g) for r in kept]
    assert len(want) < len(texts) - 50 and len(at) == len(set(at)) == len(want)


def test_stage_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    want = {frozenset(ids[k] for k in g) for g in brute_groups([texts[i] for i in ids])}
    kept = {r["doc_id"] for r in copies.drop_near_copies(docs).collect()}
    assert len(want) == len(kept) and all(len(g & kept) == 1 for g in want)


def test_each_group_keeps_one_row_with_an_id_or_not(spark):
    rows = [(None, "b b b"), (None, "c c"), (None, "C  c"), (3, "a"), (3, "an other text"), (7, "c d"), (None, "a"), (2, "a"), (2, "a"), (9, "z"), (8, "Z")]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in kept), key=str)
    assert got == sorted([(None, ["b", "b", "b"]), (None, ["c", "c"]), (3, ["an", "other", "text"]), (7, ["c", "d"]), (2, ["a"]), (8, ["z"])], key=str)


@pytest.mark.parametrize("region", [3, forest.REGION])
def test_crowded_regions(spark, monkeypatch, region):
    """Texts around one passage crowd the regions; near copies among them are found, however few a region may hold."""
    monkeypatch.setattr(forest, "REGION", region)
    g = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    passage = [g.choice(words) for _ in range(150)]
    texts = []
    for _ in range(40):
        own = passage + [g.choice(words) for _ in range(g.randint(40, 90))]
        texts.append(" ".join(own))
        if g.random() < 0.5:
            other = list(own)
            other[g.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    want = brute_groups(texts)
    kept = copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    at = [next(x for x in want if r["doc_id"] in x) for r in kept]
    assert 30 < len(want) < len(texts) and len(at) == len(set(at)) == len(want)


def test_spots_of_equal_and_other_signatures():
    g = random.Random(1)
    one = copies.signature(copies.shingle_hashes([b"w%d" % g.randrange(99) for _ in range(80)], 5))
    assert len(one) == copies.HASHES and copies.signature(copies.shingle_hashes([], 5)) is None
    both = forest.first_spots([one, one, bytes(128)])
    assert both.shape == (3, forest.TREES) and (both[0] == both[1]).all() and not set(both[0]) & set(both[2])


@pytest.mark.parametrize(("words_off", "copies_of"), [(3, 100), (9, 60)])
def test_no_near_copy_of_a_crowd_is_lost(spark, words_off, copies_of):
    """Copies at 0.85 to 0.95 of their text, many of them not near one another, beside a second such group that shares most words."""
    g = random.Random(words_off)
    one = [f"w{k}" for k in range(300)]
    two = one[:270] + [f"v{k}" for k in range(30)]
    texts = []
    for base in (one, two):
        texts.append(" ".join(base))
        for _ in range(copies_of):
            other = list(base)
            for k in g.sample(range(300), words_off):
                other[k] = f"new{g.random()}"
            texts.append(" ".join(other))
    want = brute_groups(texts)
    kept = copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert len(kept) == len(want)


def test_a_text_and_very_many_edited_copies(spark):
    """Copies that resemble the text they come from, and one another less than they should, are one group through it."""
    g = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [g.choice(words) for _ in range(200)]
    texts = []
    for _ in range(150):
        other = list(base)
        for k in g.sample(range(200), 4):
            other[k] = g.choice(words)
        texts.append(" ".join(other))
    texts.insert(100, " ".join(base))
    kept = copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert [r["doc_id"] for r in kept] == [0]
