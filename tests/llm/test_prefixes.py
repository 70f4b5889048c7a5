import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lanewise.llm import ordered, prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_turns(rows):
    """Turns (role, text) of each conversation in order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn, role or "", text or ""))
    order = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    return {c: [x[1:] for x in sorted(v, key=order)] for c, v in out.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(turns):
    """The trie's nodes by looking at every beginning of every conversation."""
    members = {}
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    own = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    sums, leaves, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            sums[p[:d]] += own[p]
            leaves[p[:d]] += not children[p]
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], sums[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(turns[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    }


def some(g, n):
    """Conversations that share beginnings of all lengths, copies among them."""
    seeds = [[(g.choice(["user", "assistant", None]), g.choice(["a b", "c", "", None, f"w {k} {j}"])) for j in range(g.randint(1, 9))] for k in range(6)]
    rows, known = [], []
    for c in range(n):
        turns = list(g.choice(seeds + known))[: g.randint(1, 9)] if known else list(seeds[0])
        turns += [("user", f"own {g.randint(0, 5)}") for _ in range(g.choice([0, 0, 1, 3]))]
        known.append(turns)
        rows += [(c - 7, g.choice([None, 0]) if j == 0 else j, r, t) for j, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_refinement_in_a_task_equals_brute_force(seed):
    g = random.Random(seed)
    turns = {c: t for c, t in in_turns(some(g, 40)).items() if t}
    members = [(c, [(repr(x).encode(), len(x[1].split())) for x in t]) for c, t in sorted(turns.items())]
    nodes = prefixes.refined(min(turns), 0, members)
    got = {(*x[:7], hashlib.sha256(",".join(map(str, x[7])).encode()).hexdigest()) for x in nodes[1:]}
    assert got == {x for x in brute(turns) if x[1] > 0}
    (root,) = (x for x in brute(turns) if x[1] == 0)
    assert tuple(nodes[0][4:7]) == root[4:7]


@pytest.mark.parametrize("class_rows", [0, 3, 30, prefixes.CLASS_ROWS])
def test_trie_equals_brute_force(spark, class_rows):
    rows = some(random.Random(5), 60)
    got = prefixes.prefix_trie(*prefixes.plain(spark.createDataFrame(rows, SCHEMA)), class_rows=class_rows)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == brute(in_turns(rows))


def test_a_long_shared_beginning_takes_no_round_a_turn(spark):
    """Two conversations of 400 turns that differ in the last one are refined in one task."""
    rows = [(c, k, "user", f"t {k}" if k < 399 else f"end {c}") for c in (3, 8) for k in range(400)]
    got = {tuple(r) for r in prefixes.prefix_trie(*prefixes.plain(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(in_turns(rows)) and len(got) == 402


def test_op12_equals_sql_and_brute_force(spark, tmp_path):
    g = random.Random(2)
    rows = some(g, 150) + [(None, 0, "user", "lost"), (1000, 0, "user", "x"), (1001, 0, "user", "x"), (1001, 0, "user", "x"), (1001, 5, "a", "é\x0b\x0cw"), (1003, 0, "user", "y " * 50_000), (-31, 0, "", "z"), (-31, 0, None, "z")]
    (tmp_path / "d").mkdir()
    at = str(tmp_path / "d" / "conversations.parquet")
    spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", parent string").coalesce(1).write.parquet(at)
    got = {tuple(r) for r in prefixes.op12_prefixes(spark, str(tmp_path / "d")).collect()}
    assert got == brute(rebuilt(in_turns(rows)))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{at}/*.parquet'")
    assert {tuple(r) for r in db.sql(prefixes.OP12_SQL).fetchall()} == got


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_trie(*prefixes.rebuilt(empty)).count() == 0
    one = prefixes.prefix_trie(*prefixes.plain(spark.createDataFrame([(4, 1, "user", "a b")], SCHEMA))).collect()
    assert {tuple(r) for r in one} == brute({4: [("user", "a b")]})
    # Conversations without turns: all begin with one whose turns are none.
    lone = prefixes.prefix_trie(*prefixes.rebuilt(spark.createDataFrame([(c, 0, "user", "a") for c in range(1001, 1010)], SCHEMA)))
    assert {tuple(r) for r in lone.collect()} == brute(rebuilt({c: [("user", "a")] for c in range(1001, 1010)}))


def test_many_copies_and_equal_rows(spark):
    rows = spark.range(4000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 3 < 2, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = rows.union(spark.range(3000).select(F.lit(5000).cast("long"), F.lit(None).cast("long"), F.lit("user"), F.lit("again")))
    got = {tuple(r) for r in prefixes.prefix_trie(*prefixes.plain(rows), class_rows=100).collect()}
    want = brute({c: [("user", "the same" if c % 3 < 2 else str(c))] for c in range(4000)} | {5000: [("user", "again")]})
    assert {x for x in got if x[0] != 5000} == {(*x[:5], x[5], x[6], x[7]) for x in want if x[0] != 5000}
    assert sorted(x[1] for x in got if x[0] == 5000) == list(range(1, 3001)) and {x[3:7] for x in got if x[0] == 5000 and x[1] < 3000} == {(1, 1, 1, 0)}


@pytest.mark.parametrize("n", [1, 3, 17])
def test_numbers_and_digests_across_tasks(spark, n):
    g = random.Random(n)
    rows = [(g.choice([1, 1, 1, 2, 3, -4]), k) for k in range(500)] + [(9, 1)]
    frame = spark.createDataFrame(rows, "key long, v long").repartition(5)
    got = ordered.numbered(ordered.in_order(frame, ["key", "v"], n=n), "key", "at").select("key", "v", "at").collect()
    want = [(key, v, k) for key, own in itertools.groupby(sorted(rows), key=lambda r: r[0]) for k, (_, v) in enumerate(own, 1)]
    assert sorted(tuple(r) for r in got) == want
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        digests = {tuple(r) for r in ordered.ordered_digests(frame, ["key"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert digests == {(key, hashlib.sha256(",".join(str(v) for k, v in sorted(rows) if k == key).encode()).hexdigest()) for key in {k for k, _ in rows}}
