import hashlib
import random
import re
import time
from collections import Counter

import pytest

from lanewise.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(text, items, window=10):
    """(words, numbers of the words hit, items) by comparing every window with every item."""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(item)
    return len(w), hit, sorted(ids)


def row(doc, text, items):
    n, hit, ids = brute(text, items)
    return (doc, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))


@pytest.fixture(scope="module")
def tables():
    g = random.Random(4)
    word = lambda: g.choice(["A", "b", "é7", "the", "x9", "of"])
    items = [(k, " ".join(word() for _ in range(g.choice([0, 2, 9, 10, 14])))) for k in range(12)] + [(50, None), (None, "z z z"), (7, "y y"), (7, "y y")]
    docs = [(k, ", ".join(word() for _ in range(g.randint(0, 60))) + (" " + items[k % 12][1] if k % 3 == 0 else "")) for k in range(40)]
    return docs + [(99, None), (98, ""), (97, "Z-z.z y"), (97, "Z-z.z y"), (None, "Y\x85y Y"), (96, "a " * 30_000 + items[3][1] + " b" * 30_000)], items


@pytest.mark.parametrize("pass_bytes", [decontaminate.PASS_BYTES, 100])
def test_rows_equal_brute_force(spark, tables, pass_bytes):
    docs, items = tables
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, TEXT string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    want = [row(i, t, named) for i, t in docs]
    got = decontaminate.digest(decontaminate.report(frame, bench, pass_bytes=pass_bytes)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(frame, bench, pass_bytes=pass_bytes)
    assert kept.columns == frame.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted((d for d, w in zip(docs, want, strict=True) if not w[-1]), key=str)
    left = decontaminate.remove_spans(frame, bench, pass_bytes=pass_bytes)
    assert left.columns == frame.columns
    hit = [brute(t, named)[1] for _, t in docs]
    want = [(i, [w for k, w in enumerate(words(t)) if k not in h]) for (i, t), h in zip(docs, hit, strict=True)]
    assert sorted(((r[0], words(r[1])) for r in left.collect()), key=str) == sorted(want, key=str)
    untouched = [d for d, h in zip(docs, hit, strict=True) if not h]
    assert not Counter(untouched) - Counter(tuple(r)[:2] for r in left.collect())


@pytest.mark.parametrize("pass_bytes", [20, 60, decontaminate.PASS_BYTES])
def test_overlapping_items_are_cut_once(spark, pass_bytes):
    """Passages that overlap go whole, whichever pass finds them, and a cut makes no new passage."""
    a, b = [f"w{k}" for k in range(10)], [f"w{k}" for k in range(5, 15)]
    x = [f"x{k}" for k in range(5)] + [f"y{k}" for k in range(1, 6)]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(x))], "item_id long, text string")
    docs = [(1, " ".join(f"w{k}" for k in range(15))), (2, " ".join([*x[:5], *a, *x[5:]])), (3, "clean words"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, Text string")
    got = {r[0]: r[1] for r in decontaminate.remove_spans(frame, bench, pass_bytes=pass_bytes).collect()}
    assert got[1] == "" and words(got[2]) == [w.encode() for w in x] and got[3] == "clean words" and got[4] is None
    assert {r[0] for r in decontaminate.drop_contaminated(frame, bench, pass_bytes=pass_bytes).collect()} == {3, 4}


def test_a_worker_holds_one_pass_at_a_time(spark, tables):
    docs, items = tables
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for f in (decontaminate.report, decontaminate.drop_contaminated, decontaminate.remove_spans):
        # However many passes there were, what is left to run is one merge of their hits and at most one cut.
        plans = [f(frame, bench, pass_bytes=n)._jdf.queryExecution().optimizedPlan().toString() for n in (150, 60)]
        assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") <= 2


def test_rows_of_a_table_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    want = {row(r["doc_id"], r["text"], items) for r in docs.collect()}
    assert {tuple(r) for r in decontaminate.op9_decontaminate(spark, sf).collect()} == want and any(w[-1] for w in want)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_change_nothing(tables, monkeypatch, block):
    docs, items = tables
    named = [(str(i), t) for i, t in items]
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    windows = decontaminate.Windows(named, 10)
    for _, t in docs[:40]:
        n, ranges, found = windows.hits(t.encode())
        assert (n, {k for a, b in ranges for k in range(a, b)}, sorted(found)) == brute(t, named)


def test_equal_hashes_of_other_words_are_no_hits(monkeypatch):
    monkeypatch.setattr(decontaminate, "hashes", lambda words, starts, ends, n: iter([(0, __import__("numpy").zeros(max(0, len(starts) - n + 1), "uint64"))] if len(starts) >= n else []))
    items = [("1", "a b"), ("2", "c d"), ("3", "c d")]
    windows = decontaminate.Windows(items, 10)
    for t in ("x a b", "c d e", "x y", "a b c d"):
        n, ranges, found = windows.hits(t.encode())
        assert (n, {k for a, b in ranges for k in range(a, b)}, sorted(found)) == brute(t, items)


def test_large_benchmarks_and_texts():
    """16 MB of items and a text of 6 MB take seconds and the memory stated."""
    import pickle

    g = random.Random(1)
    items = [(str(k), " ".join(str(g.randrange(50_000)) for _ in range(300))) for k in range(9000)]
    began = time.monotonic()
    windows = decontaminate.Windows(items, 10)
    assert len(pickle.dumps(windows)) < 16 * sum(len(t) for _, t in items)
    text = " ".join(str(g.randrange(50_000)) for _ in range(1_000_000)) + " " + items[77][1]
    n, ranges, found = windows.hits(text.encode())
    assert n == 1_000_300 and found >= {"77"} and ranges[-1] == (1_000_000, 1_000_300)
    assert time.monotonic() - began < 30


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert [r["n_hit"] for r in decontaminate.report(docs, bench.limit(0)).collect()] == [0]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 1
