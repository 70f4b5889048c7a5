import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import copies, forest

SCHEMA = "doc_id long, text string"


def sets(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Links and least ids by comparing all that share one of their rarest shingles; every link does."""
    own = [(i, sets(t)) for i, t in rows]
    often = Counter(x for _, s in own for x in s)
    held, links = defaultdict(list), []
    for k, (_, s) in enumerate(own):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - (85 * len(s) + 99) // 100 + 1]:
            near.update(held[x])
            held[x].append(k)
        links += [(j, k) for j in near if 100 * len(s & own[j][1]) >= 85 * len(s | own[j][1])]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(own):
        least[top(k)] = min(least.get(top(k), i), i)
    return links, {(i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(own)}


def edited(g, words, n):
    words = list(words)
    for _ in range(n):
        words[g.randrange(len(words))] = f"new{g.random()}"
    return words


def found(spark, rows, parts=8):
    return {tuple(r) for r in forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}


def test_pairs_at_all_similarities(spark):
    """Chains of edits: neighbours are above and below the similarity, in groups that few other texts are like."""
    g = random.Random(1)
    texts = []
    for _ in range(60):
        words = [f"w{g.randrange(3000)}" for _ in range(g.choice([3, 8, 40, 150, 400]))]
        for _ in range(g.randint(1, 6)):
            texts.append(" ".join(words))
            words = edited(g, words, g.choice([0, 1, 1, max(1, len(words) // 60), len(words) // 40 + 1]))
    rows = list(enumerate(texts))
    links, want = brute(rows)
    assert len(links) > 60 and found(spark, rows) == want


@pytest.mark.parametrize(("share", "seed"), [(0.01, 2), (0.025, 4)])
def test_a_crowd_of_copies(spark, share, seed):
    """Copies of one text that are near it but, edited at places of their own, often not near one another; pairs of copies among them that
    are near each other only; and texts that share half of it."""
    g = random.Random(seed)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)] + [" ".join(edited(g, base, round(400 * share))) for _ in range(300)]
    for _ in range(40):
        far = edited(g, base, 16)
        texts += [" ".join(far), " ".join(edited(g, far, 3))]
    texts += [" ".join(base[:200] + [f"x{g.random()}" for _ in range(200)]) for _ in range(100)]
    g.shuffle(texts)
    rows = list(enumerate(texts))
    links, want = brute(rows)
    root = {i: c for i, _, c, _ in found(spark, rows)}
    lost = sum(root[a] != root[b] for a, b in links)
    assert lost == 0 and root == {i: c for i, _, c, _ in want}


def test_two_crowds_side_by_side(spark):
    """Copies of one text and copies of another that shares most of its words with the first: each group has its own centre."""
    g = random.Random(6)
    one = [f"w{k}" for k in range(300)]
    two = one[:280] + [f"v{k}" for k in range(20)]
    texts = [" ".join(one), " ".join(two)] + [" ".join(edited(g, x, 6)) for x in [one] * 160 + [two] * 100]
    rows = list(enumerate(texts))
    links, want = brute(rows)
    assert found(spark, rows) == want


def test_regions_go_deeper_only_where_crowded(spark):
    g = np.random.default_rng(3)
    base = g.integers(0, 256, copies.HASHES, np.uint8)
    signs = [base.tobytes()]
    for _ in range(200):
        own = base.copy()
        own[g.random(copies.HASHES) < 0.1] = g.integers(0, 256)
        signs.append(own.tobytes())
    signs += [g.integers(0, 256, copies.HASHES, np.uint8).tobytes() for _ in range(300)]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(signs)], "node long, sign binary")
    pairs = {(r["a"], r["b"], r["hub"]) for r in forest.candidates(frame).collect()}
    # The text that the others are copies of is most often their hub, and no text that is like no other has a partner.
    assert {b for a, b, _ in pairs if a == 0} == set(range(1, 201)) and all(b <= 200 for _, b, _ in pairs)
    # Far fewer pairs than all 20,100, and each once.
    assert len({p[:2] for p in pairs}) == len(pairs) < 12_000


def test_a_hub_is_dealt_in_copies(spark, monkeypatch):
    monkeypatch.setattr(forest, "SERVED", 3)
    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t {k}".encode()) for k in range(50)]
    texts = spark.createDataFrame(rows, "row long, text binary")
    pairs = spark.createDataFrame([(k, 49, 49) for k in range(49)] + [(3, 7, 3)], "a long, b long, hub long")
    got = {tuple(r) for r in forest.confirmed(pairs, texts, 3, (85, 100)).collect()}
    assert got == {(k, 49) for k in range(49)} | {(3, 7)}
    assert forest.confirmed(pairs, texts, 3, (99, 100)).count() == 0


def test_a_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links, want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(links) > 50 and {tuple(r) for r in forest.op13_forest(spark, "/root/testdata/sf0.01").collect()} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, Text string"
    rows = [(1, "", "x"), (2, None, "x"), (3, "a", "x"), (4, "A", "x"), (4, "a", "x"), (5, "a b", "x"), (None, "A\tb", "x"), (None, "q q q", "x"), (9, "long " * 200_000, "x"), (8, "long long long long", "x"), (7, " \n\v", "x")]
    got = sorted((tuple(r) for r in forest.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (7, 0, 7, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True), (9, 1, 8, False), (8, 1, 8, True)]
    assert got == sorted(want, key=str)
    empty = forest.near_duplicates(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_most_rows_are_one_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "the same text of all").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = forest.near_duplicates(docs)
    assert got.count() == 3000 and got.where("component_id = 0").count() == 2000 and got.where("kept").count() == 1001


def test_the_pairs_of_a_small_frame_are_all_considered():
    """Of all pairs of signatures at 0.85 or more, those that share a beginning in no tree: none of many."""
    g = np.random.default_rng(5)
    one = g.integers(0, 256, (2000, copies.HASHES), np.uint8)
    two = np.where(g.random(one.shape) < 0.85, one, g.integers(0, 256, one.shape, np.uint8))
    a, b = (forest.first_spots([s.tobytes() for s in x]) for x in (one, two))
    assert (a == b).any(axis=1).all()
    assert len(set(itertools.chain(*forest.first_spots([one[0].tobytes()]).tolist()))) == forest.TREES
