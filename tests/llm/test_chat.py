import hashlib
import itertools
import random
import time

import duckdb
import pytest

from lanewise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, schema=SCHEMA):
    """The tree and what is read back from it, against the conversations themselves."""
    tree = chat.prefix_tree(spark.createDataFrame(rows, schema))
    nodes = {bytes(r["key"]): r for r in tree.nodes.collect()}
    spans = sorted((r["emitted"], r["emitted"] + r["n_tokens"]) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    stack = []
    for r in sorted(nodes.values(), key=lambda r: r["emitted"]):  # depth first: each parent is still open
        del stack[r["depth"] :]
        assert len(stack) == r["depth"] and (r["parent"] is None if not stack else bytes(r["parent"]) == stack[-1])
        up = [nodes[k] for k in stack]
        stack.append(bytes(r["key"]))
        assert r["position"] == sum(x["n_tokens"] for x in up) == sum(i["hi"] - i["lo"] for i in r["attends"])
        assert {p for i in r["attends"] for p in range(i["lo"], i["hi"])} == {p for x in up for p in range(x["emitted"], x["emitted"] + x["n_tokens"])}
        assert all(a["hi"] != b["lo"] for a, b in itertools.pairwise(r["attends"]))
        assert len(r["tokens"]) == 4 * r["n_tokens"] and 0 <= r["loss_from"] <= r["loss_to"] <= r["n_tokens"]
    convs, prefixes, want = {}, set(), {}
    for c, k, r, t, *_ in rows:
        convs.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    for c, ts in convs.items():
        ts.sort()
        prefixes |= {tuple(x[1:] for x in ts[: k + 1]) for k in range(len(ts))}
        text = "".join(t for _, r, t in ts if r == "assistant")
        want[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())
    assert len(prefixes) == len(nodes)
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(tree).collect()} == want
    return tree, nodes


def test_tree_of_shared_turns(spark):
    turns = [("system", "be good"), ("user", "hi <x> \\ ### b: </turn>"), ("assistant", None), ("user", None)]
    rows = [(c, k, r, f"a{c % 3}" if r == "assistant" else t) for c in range(6) for k, (r, t) in enumerate(turns)]
    odd = [(None, 0, None, "x"), (None, 0, None, "x"), (None, None, "user", "y"), (8, None, "assistant", ""), (0, 9, "user", "x"), (9, 3, "assistant", "é" * 70_000)]
    _, nodes = check(spark, [(*r, "clash") for r in rows + odd], SCHEMA + ", TEXT string")
    assert len(nodes) == 2 + 3 * 2 + 3 + 1 + 1 + 1
    assert chat.parse("".join(chat.segments(chat.PLANTED, chat.PLANTED))) == [(chat.PLANTED, chat.PLANTED)]


@pytest.mark.parametrize("seed", range(3))
def test_tree_of_random_conversations(spark, seed):
    g = random.Random(seed)
    rows = [(c, k, g.choice(["user", "assistant"]), g.choice("ab")) for c in range(60) for k in range(g.randint(1, 7))]
    _, nodes = check(spark, rows + [r for r in rows if r[0] == 3])
    assert max(len(r["attends"]) for r in nodes.values()) >= 2


def test_conversations_that_leave_a_spine_at_every_depth(spark):
    check(spark, [(c, k, "user", f"s{k}" if k < c else "x") for c in range(30) for k in range(c + 1)])
    check(spark, [(c, k, "user", f"s{k}") for c in range(20) for k in range(c + 1)])


def test_long_conversations_take_linear_space(spark):
    n = 20_000
    rows = spark.range(2 * n).selectExpr("id % 2 as conv_id", "id div 2 as turn", "if(id % 4 < 2, 'user', 'assistant') as role", f"concat('turn ', id div 2, if(id >= {n} and id % 2 = 1, 'x', '')) as text")
    began = time.monotonic()
    tree = chat.prefix_tree(rows)
    out = {r["conv_id"]: r for r in chat.read_back(tree).collect()}
    assert time.monotonic() - began < 60
    assert tree.nodes.count() == n + n // 2 and {r["n_turns"] for r in out.values()} == {n}
    text = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\nturn {k}{'x' * (k >= n // 2)}\n" for k in range(n))
    assert out[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert max(len(r[0]) for r in tree.nodes.select("attends").distinct().collect()) <= 2


def test_a_conversation_of_most_rows(spark):
    rows = spark.range(3000).selectExpr("if(id < 2400, id div 4, 600 + id) as conv_id", "id % 4 as turn", "'user' as role", "if(id < 2400, concat('same ', id % 4), cast(id as string)) as text")
    tree = chat.prefix_tree(rows)
    assert tree.nodes.count() == 4 + 600 and chat.read_back(tree).select("turns_sha256").distinct().count() == 601


def test_a_missing_node_fails(spark):
    rows = [(c, k, "user", f"{k}{c if k else ''}") for c in range(3) for k in range(3)]
    tree = chat.prefix_tree(spark.createDataFrame(rows, SCHEMA))
    for lost in ("depth = 0", "depth = 2"):
        with pytest.raises(Exception, match="tree"):
            chat.read_back(tree._replace(nodes=tree.nodes.where(f"not ({lost})"))).collect()


def test_empty_table(spark):
    tree = chat.prefix_tree(spark.createDataFrame([], SCHEMA))
    assert tree.nodes.count() == 0 and chat.read_back(tree).count() == 0


def test_query_equals_its_sql(spark):
    d = duckdb.connect()
    d.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = d.sql(chat.OP1_SQL)
    names = want.columns
    assert {tuple(r) for r in chat.op1_chat(spark, "/root/testdata/sf0.01").select(names).collect()} == set(want.fetchall())
