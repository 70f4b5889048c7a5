import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanewise.llm import simhash

SCHEMA = "doc_id long, text string"


def prints_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = {i: prints_of(t) for i, t in rows}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {(i, f"{prints[i]:016x}", root[i]) for i in prints}


def clustered(seed, centres=40):
    """Values around centres, up to four bits away: groups that branch, and chains of links."""
    g, out = random.Random(seed), set()
    for _ in range(centres):
        c = g.getrandbits(64)
        for _ in range(g.choice([1, 5, 40])):
            x = c
            for _ in range(g.randint(0, 4)):
                x ^= 1 << g.randrange(64)
            out.add(x)
    return sorted(out)


def close(values, budget=2):
    return {(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= budget}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("at_once", [7, 1 << 18])
def test_walk_finds_every_close_pair_once(seed, at_once):
    values = clustered(seed)
    walk = simhash.Walk(np.array(values, np.uint64), 2, 0, at_once)
    n = len(values)
    pairs = [tuple(sorted(p)) for x in walk.close(np.array([[0, n, 0, n]])) for p in x.T.tolist()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == close(values)
    # The walk visits far fewer pairs of nodes than there are pairs of values, and leaves pairs above their leaves.
    assert n < walk.visited < n * n / 4 and walk.pruned > n


def test_a_spent_bit_within_the_top_block_ends_a_walk():
    values = clustered(9)
    walk = simhash.Walk(np.array(values, np.uint64))
    n = len(values)
    found = {tuple(sorted(p)) for x in walk.close(np.array([[0, n, 0, n]])) for p in x.T.tolist()}
    assert found == {(a, b) for a, b in close(values) if (values[a] ^ values[b]) >> 43 == 0}
    assert walk.pruned > 0


def edges(found):
    return {tuple(r) for r in found.collect()}


def joined(values, links):
    root = {v: v for v in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


@pytest.mark.parametrize("subtree", [simhash.SUBTREE, 3, 1])
def test_links_connect_what_is_close_however_subtrees_are_dealt(spark, subtree):
    # All values share their first 16 bits in two tries, so that small limits split their subtrees.
    g = random.Random(5)
    values = sorted({(c ^ 1 << g.randrange(64)) & 0xFFFF | 0xABCD << 48 | (c >> 3 & 0x7FF) << 20 for c in clustered(6, 60)} | {x ^ 3 << 40 for x in clustered(6, 5)} | set(clustered(6, 5)))
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in edges(simhash.links(frame, subtree))]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    pairs = [(values[a], values[b]) for a, b in close(values)]
    assert len(pairs) > 100 and joined(values, links) == joined(values, pairs)


@pytest.mark.parametrize("subtree", [simhash.SUBTREE, 1])
def test_simhash_equals_brute_force(spark, subtree):
    g = random.Random(2)
    base = [" ".join(g.choice(["The", "cat", "sat", "on", "mat", "ein", "é"]) for _ in range(g.randint(0, 300))) for _ in range(30)]
    rows = list(enumerate(base + [b + " end" for b in base] + base[:5] + ["", None]))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), subtree=subtree)
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def test_simhash_of_a_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == brute_components(rows)


def test_the_walk_runs_over_a_table(spark):
    """Trees of real documents branch, and their walk leaves pairs of nodes."""
    prints = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct()
    rows = simhash.deal(prints).where("trie = 0").select("v").toPandas()
    v = np.sort(rows["v"].to_numpy().view(np.uint64))
    walk = simhash.Walk(v)
    list(walk.close(np.array([[0, len(v), 0, len(v)]])))
    assert walk.visited > len(v) > 500 and walk.pruned > 100


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, Text string"
    rows = [(1, "", "en", "x"), (2, None, None, None), (3, "a", "en", "x"), (3, "a", "en", "x"), (None, "b b b", "en", "x"), (9, "x" * 50_000, "en", "x"), (3, "another", "en", "x")]
    odd = spark.createDataFrame(rows, schema)
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(rows) and {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (9, 9), (None, None)], key=str)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, ""), (3, "a"), (3, "another"), (9, "x" * 50_000), (None, "b b b")], key=str)
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_a_fingerprint_of_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "the same text of all").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.count() == 3000 and got.where("component_id = 0").count() == 2000
