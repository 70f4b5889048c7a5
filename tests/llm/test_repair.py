import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lanewise.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?$")
BLANK = " \t\n\v\f\r"


def kinds(rows):
    """(role, text, must go, truncated) of rows in order, and the counts of faults."""
    seen, out, faults = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.rstrip(BLANK)
        blank, again = not bare, bool(bare) and (role, text) in seen
        cut = not blank and not again and bare[-1] not in ".!?"
        seen.add((role, text))
        faults = [x + y for x, y in zip(faults, (blank, again, cut), strict=True)]
        out.append((role, text, blank or again, cut))
    return out, faults


def all_ways(turns, inserts):
    """(cost, audit, repaired) of every sequence of edits with at most so many inserts between two turns that gives legal roles."""

    def go(k, cost, audit, made):
        for n in range(inserts + 1):
            for added in itertools.product("ua", repeat=n):
                run = [*made, *((("user" if x == "u" else "assistant"), "") for x in added)]
                c, a = cost + 5 * n, audit + "I" * n
                if k == len(turns):
                    if LEGAL.match("".join(r[:1] or "?" for r, _ in run)):
                        yield c, a, run
                    continue
                role, text, forced, cut = turns[k]
                yield from go(k + 1, c + 2, a + "D", run)
                if not forced:
                    yield from go(k + 1, c + 5 * cut, a + "K", [*run, (role, text)])
                    for r in ("user", "assistant"):
                        yield from go(k + 1, c + 1 + 5 * cut, a + "R", [*run, (r, text)])

    return go(0, 0, "", [])


def least(turns):
    """The least (cost, audit, repaired): states carry whole audit strings, with up to two inserts before a turn."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", [])}
    for role, text, forced, cut in turns:
        new = {}
        for state, (c, a, m) in best.items():
            for n in range(3):
                ways = [(2, "D", state, [])]
                if not forced:
                    if role[:1] in after[state]:
                        ways.append((5 * cut, "K", role[:1], [(role, text)]))
                    to = "a" if state == "u" else "u"
                    ways.append((1 + 5 * cut, "R", to, [("user" if to == "u" else "assistant", text)]))
                for cost, e, to, made in ways:
                    now = (c + cost, a + e, [*m, *made])
                    if to not in new or now[:2] < new[to][:2]:
                        new[to] = now
                to = "a" if state == "u" else "u"
                c, a, m, state = c + 5, a + "I", [*m, ("user" if to == "u" else "assistant", "")], to
        best = new
    ended = []
    for state, (c, a, m) in best.items():
        while state in ("s", "u"):
            to = "a" if state == "u" else "u"
            c, a, m, state = c + 5, a + "I", [*m, ("user" if to == "u" else "assistant", "")], to
        ended.append((c, a, m))
    return min(ended, key=lambda x: x[:2])


def report(rows):
    """The contract's columns but conv_id of rows (turn, role, text) in order."""
    turns, faults = kinds([r[1:] for r in rows])
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, made = least(turns)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def some(g, n):
    texts = ["Yes.", "No", "", " \n", "Why?", "so on\t", "End!  "]
    return [(g.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), g.choice(texts) if g.random() < 0.6 else f"text {g.random()}{g.choice(['.', ''])}") for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_the_plain_program_equals_all_edits(seed):
    g = random.Random(seed)
    turns, _ = kinds(some(g, g.randint(0, 3)))
    assert least(turns)[:2] == min(x[:2] for x in all_ways(turns, 2))


def part_of(turns, keep=True):
    part = repair.Part((1, 1), keep)
    for role, text, forced, cut in turns:
        part.turns.append(repair.Turn("" if forced or role[:1] not in ("s", "u", "a") else role[:1], forced, cut and not forced))
        part.rows.append((role, text))
    return part


@pytest.mark.parametrize("seed", range(300))
def test_ranks_equal_audit_strings_whole_and_in_parts(seed):
    g = random.Random(seed)
    turns, _ = kinds(some(g, g.randint(0, 40)))
    cost, audit, made = least(turns)
    part = part_of(turns)
    layer, parents, base = part.worked([0])
    last, inserts, k = repair.closed(layer)
    got, out, _ = part.repaired(repair.codes(parents, k), 0, inserts)
    assert (last + base, got, [x[1:] for x in out]) == (cost, audit, made)
    # The same in parts, each worked from every state.
    borders = sorted(g.randint(0, len(turns)) for _ in range(g.randint(1, 4)))
    parts = [part_of(turns[a:b]) for a, b in zip([0, *borders], [*borders, len(turns)], strict=True)]
    total, ways, inserts = repair.entries([p.matrix() for p in parts])
    text = ""
    for n, (p, (entered, left)) in enumerate(zip(parts, ways, strict=True)):
        layer, parents, _ = p.worked([entered])
        k = next(k for k, x in enumerate(layer) if x[1] == left)
        text += p.repaired(repair.codes(parents, k), entered, inserts * (n + 1 == len(parts)))[0]
    assert (total, text) == (cost, audit)


def test_layers_recur():
    """The steps that long conversations of any roles need are few."""
    g = random.Random(4)
    repair._known.clear()
    part_of(kinds(some(g, 3000))[0]).worked([0])
    few = len(repair._known)
    part_of(kinds(some(g, 30000))[0]).worked(range(4))
    assert few < 400 and len(repair._known) < 5000


def conversations(g, n):
    out = []
    for c in range(n):
        turn = g.randint(-3, 5)
        for role, text in some(g, g.choice([0, 1, 2, 5, 9])):
            out.append((c, turn if g.random() < 0.9 else None, role, text if g.random() < 0.95 else None))
            turn += g.choice([0, 1, 1, 1, 2])
    return out


def expected(rows):
    """Reports by conversation of damaged rows (conv_id, turn, role, text, n_rows)."""
    groups = {}
    for c, turn, role, text, n in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups.setdefault(c, []).extend([(turn, role, text)] * n)
    order = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    return {(c, *report(sorted(v, key=order))) for c, v in groups.items()}


@pytest.mark.parametrize("parts", [None, 1, 40])
def test_repair_equals_brute_force(spark, parts):
    g = random.Random(8)
    rows = [(*r, g.choice([0, 1, 1, 1, 1, 2, 3])) for r in conversations(g, 40)] + [(None, k, "user", f"t{k}", 1) for k in range(5)]
    rows += [(77, k, *some(g, 1)[0], 1) for k in range(600)]  # one conversation over many tasks
    got = repair.repair(spark.createDataFrame(rows, SCHEMA + ", n_rows int"), parts)
    assert {tuple(r) for r in got.reports.collect()} == expected(rows)
    made = {}
    for r in sorted(got.turns.collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r[0]: r[-1] for r in expected(rows)}
    assert {c: hashlib.sha256("\n".join(m).encode()).hexdigest() for c, m in made.items()} == {c: d for c, d in digests.items() if c in made}
    got.free()


def damage(rows):
    for c, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        yield c, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text, 0 if code == 0 else 2 if code == 3 else 1


def test_op11_equals_sql_and_brute_force(spark, tmp_path):
    g = random.Random(3)
    rows = conversations(g, 120) + [(None, None, None, None), (None, 3, "user", "é?\v"), (5000, 1, "assistant", "x" * 200_000), (5001, None, "user", "a"), (5001, None, "user", "a")]
    (tmp_path / "d").mkdir()
    at = str(tmp_path / "d" / "conversations.parquet")
    spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", extra string").coalesce(1).write.parquet(at)
    got = {tuple(r) for r in repair.op11_repair(spark, str(tmp_path / "d")).collect()}
    assert got == expected(list(damage(rows)))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{at}/*.parquet'")
    assert {tuple(r) for r in db.sql(repair.OP11_SQL).fetchall()} == got


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).reports.count() == 0 and repair.repair(empty).turns.count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a.", "x"), (1, 1, "assistant", "b.", "x")], "conv_id long, turn long, role string, text string, Text string")
    assert [tuple(r)[:8] for r in repair.repair(clash).reports.collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]
    hot = spark.createDataFrame([(1, 0, "user", "a.", 5000), (2, 0, "user", "a.", 0)], SCHEMA + ", n_rows int")
    rows = {r["conv_id"]: r for r in repair.repair(hot).reports.collect()}
    assert rows[1]["duplicate"] == 4999 and rows[1]["audit"] == "D" * 5000 and rows[1]["cost"] == 10_000 and rows[1]["illegal"] == 4999
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
