"""Repair of a conversation's structure by a rank-compressed dynamic program.

The cheapest edits make a conversation's roles read (s?(ua)+)?, and of several cheapest ones the ASCII-least audit string counts. Each
turn is consumed by one macro edit: a run of inserts, then Delete, Keep or Rerole. A macro's letters are I, ..., I and one letter other
than I, so no macro's code is the beginning of another's: audits of the same turns compare as sequences of code numbers. A layer of the
program (after one more turn) therefore needs no audit strings, only the rank of each state's best audit among the layer's, and each
state's parent; audits are read off the parents afterwards. Costs are kept relative to the layer's least one and states that are too
dear to matter are left out, so layers recur, and the step from one layer over one kind of turn is worked out once.

A conversation of very many turns is spread over neighbouring tasks. Such a task works the program from every state it may be entered
in, and ranks all those audits together: its part of the conversation is then one macro itself, with a cost and a rank for each
(entered, left), and the parts' entries follow from the same program over parts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, partitions, pick, small, table
from .ordered import in_order, joined_pieces

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States by the last role that stands: none, system, user, assistant. Which state a role's initial leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES, ENDS = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Inserts before a turn, and at the end: any state is two inserts from any it can reach so.
RUN = 2
#: Codes of the macro edits in ASCII order.
CODES = sorted("I" * k + e for k in range(RUN + 1) for e in "DKR")
_CODE = {c: k for k, c in enumerate(CODES)}
#: A state dearer than the least by more than this wins nothing: two inserts and a deletion bring the least one to where it is.
DEAR = RUN * INSERT + DELETE
BLANKS = " \t\n\v\f\r"
#: Kinds of steps that a worker remembers.
REMEMBERED = 1 << 16


def inserted(state: int) -> str:
    """The initial of the only role that an insert can add."""
    return "a" if state == 2 else "u"


class Turn(NamedTuple):
    """What the program needs to know of a turn: the role's initial, whether it must go, whether it is truncated."""

    initial: str
    forced: bool
    truncated: bool


def macros(state: int, turn: Turn) -> Iterator[tuple[int, int, int]]:
    """(code, state after it, cost) of each macro edit of a turn."""
    cost = 0
    for k in range(RUN + 1):
        run = "I" * k
        yield _CODE[run + "D"], state, cost + DELETE
        if not turn.forced:
            more = cost + TRUNCATED * turn.truncated
            if (to := STEPS[state].get(turn.initial)) is not None:
                yield _CODE[run + "K"], to, more + KEEP
            yield _CODE[run + "R"], STEPS[state][inserted(state)], more + REROLE
        state, cost = STEPS[state][inserted(state)], cost + INSERT


#: A layer: (entered, state, cost, rank) in order. The state entered is the same in all of them where it is known.
Layer = tuple[tuple[int, int, int, int], ...]


def pruned(best: dict[tuple[int, int], tuple], base: int) -> tuple[Layer, tuple]:
    """The layer and each state's (parent, code) from best: (cost, rank before, code, parent) for each (entered, state)."""
    least: dict[int, int] = {}
    for (p, _), x in best.items():
        least[p] = min(least.get(p, x[0]), x[0])
    kept = sorted((k, x) for k, x in best.items() if x[0] <= least[k[0]] + DEAR)
    ranks = {r: n for n, r in enumerate(sorted({x[1:3] for _, x in kept}))}
    return tuple((*k, x[0] - base, ranks[x[1:3]]) for k, x in kept), tuple((x[3], x[2]) for _, x in kept)


_known: dict[tuple[Layer, Turn], tuple[Layer, tuple, int]] = {}


def step(layer: Layer, turn: Turn) -> tuple[Layer, tuple, int]:
    """The next layer, each of its states' (index in the layer before, code), and by how much its costs are less than they are in all."""
    if found := _known.get((layer, turn)):
        return found
    best: dict[tuple[int, int], tuple] = {}
    for k, (entered, state, cost, rank) in enumerate(layer):
        for code, to, more in macros(state, turn):
            now = (cost + more, rank, code, k)
            if (key := (entered, to)) not in best or now < best[key]:
                best[key] = now
    base = min(x[0] for x in best.values())
    found = (*pruned(best, base), base)
    if len(_known) < REMEMBERED:
        _known[layer, turn] = found
    return found


def begun(entered: range | list[int]) -> Layer:
    return tuple((p, p, 0, 0) for p in entered)


def closed(layer: Layer) -> tuple[int, int, int]:
    """(cost, inserts at the end, index) of the best way to end after a layer."""
    ways = []
    for k, (_, state, cost, rank) in enumerate(layer):
        n = 0
        while state not in ENDS:
            state, n = STEPS[state][inserted(state)], n + 1
        ways.append((cost + n * INSERT, rank, n, k))
    cost, _, n, k = min(ways)
    return cost, n, k


def codes(parents: list[tuple], k: int) -> list[int]:
    """The codes that lead to index k of the last layer, from each layer's parents."""
    out = []
    for layer in reversed(parents):
        k, code = layer[k]
        out.append(code)
    return out[::-1]


class Part:
    """A run of a conversation's rows in one task: what it counts and the kinds of its turns."""

    def __init__(self, key: tuple, keep: bool):
        self.key, self.keep = key, keep
        self.rows: list[tuple[str, str]] = []
        self.turns: list[Turn] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, n: int, repeated: bool) -> None:
        """n equal rows, repeated if an equal row stands at an earlier turn."""
        bare, initial = text.rstrip(BLANKS), role[:1]
        blank, broken = not bare, bare[-1:] not in (".", "!", "?")
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        for k in range(n):
            again = not blank and (repeated or k > 0)
            self.blank += blank
            self.duplicate += again
            self.truncated += broken and not blank and not again
            if self.last_initial is not None:
                self.illegal += self.last_initial + initial not in ("su", "ua", "au")
            else:
                self.first_initial = initial
            self.last_initial = initial
            self.turns.append(Turn("", True, False) if blank or again else Turn(initial if initial in ("s", "u", "a") else "", False, broken))
            if self.keep:
                self.rows.append((role, text))

    def worked(self, entered: range | list[int]) -> tuple[Layer, list[tuple], int]:
        """The last layer, the parents of all, and the cost that the layer's are relative to."""
        layer, parents, base = begun(entered), [], 0
        for turn in self.turns:
            layer, up, more = step(layer, turn)
            parents.append(up)
            base += more
        return layer, parents, base

    def matrix(self) -> list[tuple[int, int, int, int]]:
        """(entered, left, cost, rank) of each way through."""
        layer, _, base = self.worked(STATES)
        return [(p, q, cost + base, rank) for p, q, cost, rank in layer]

    def repaired(self, path: list[int], state: int, inserts: int) -> tuple[str, list[tuple[str, str, str]], int]:
        """The audit, the repaired (edit, role, text) and the state after it."""
        out = []
        for code, (role, text) in zip(path, self.rows, strict=True):
            for e in CODES[code]:
                if e == "K":
                    state = STEPS[state][role[:1]]
                    out.append((e, role, text))
                elif e != "D":
                    to = inserted(state)
                    state = STEPS[state][to]
                    out.append((e, ROLES[to], text if e == "R" else ""))
        for _ in range(inserts):
            to = inserted(state)
            state = STEPS[state][to]
            out.append(("I", ROLES[to], ""))
        return "".join(CODES[c] for c in path) + "I" * inserts, out, state


def entries(parts: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """The cost of a conversation in several parts, each part's (entered, left) and the inserts at the end, from the parts' matrices."""
    layer, parents, base = begun([0]), [], 0
    for ways in parts:
        at = {state: (cost, rank, k) for k, (_, state, cost, rank) in enumerate(layer)}
        best: dict[tuple[int, int], tuple] = {}
        for p, q, more, rank in ways:
            if p in at:
                cost, before, k = at[p]
                now = (cost + more, before, rank, k)
                if (0, q) not in best or now < best[0, q]:
                    best[0, q] = now
        least = min(x[0] for x in best.values())
        layer, up = pruned(best, least)
        parents.append([(k, layer_state) for (k, _), (_, layer_state, _, _) in zip(up, layer, strict=True)])
        base += least
    cost, inserts, k = closed(layer)
    lefts = []
    for up in reversed(parents):
        k, left = up[k]
        lefts.append(left)
    lefts.reverse()
    return cost + base, list(zip([0, *lefts], lefts, strict=False)), inserts


def counted(key: list[str], conversations: DataFrame) -> DataFrame:
    """The rows by conversation and place: equal rows of a turn once, with their number, each with whether an equal one stands at an earlier
    turn. The latter comes as rows of its own that are dealt to the same place: texts are not dealt for it."""
    rows = conversations.withColumn("k", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    light = rows.where("n > 0").select(*key, F.struct("t0", "t1").alias("at"), "k")
    seen = light.groupBy(*key, "k").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    marks = light.join(seen, [*key, "k"]).where("at > first").select(*key, "at.t0", "at.t1", "k").distinct()
    once = rows.groupBy(*key, "t0", "t1", "k", "role", "text").agg(F.sum("n").alias("n"))
    return once.unionByName(marks.select("*", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).cast("long").alias("n")))


_KEY = ["a", "c"]
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parts_of(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple[int, Part, bool]]:
    """(number of the task, part, whether it is the task's first) for each conversation of a task, as the rows go by."""
    now, number, first, mark = None, 0, True, None
    for batch in batches:
        for a, c, t0, t1, k, role, text, n, number in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if now is None or now.key != (a, c):
                if now is not None:
                    yield number, now, first
                    first = False
                now, mark = Part((a, c), keep), None
            if n < 0:
                mark = (t0, t1, k)
            elif n:
                now.add(t1 if t0 else None, role, text, n, mark == (t0, t1, k))
    if now is not None:
        yield number, now, first


def borders(rows: DataFrame) -> list[tuple[int, bool, bool, Part, list]]:
    """(task, first, last, part, matrix) of each task's first and last conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], None
        for number, part, first in parts_of(batches, False):
            if first:
                out.append([number, True, False, part])
            held = [number, first, True, part]
        if held:
            out = [held] if held[1] else [*out, held]
        for x in out:
            x.append(x[3].matrix())
            x[3].turns = []
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x) for x in out], pa.binary())], names=["x"])

    return sorted((pickle.loads(r[0]) for r in small(rows).mapInArrow(run, "x binary").collect()), key=lambda x: (x[0], not x[1]))


def totals(parts: list[Part]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation's parts."""
    known = [p for p in parts if p.first_turn is not None]
    same = sum(p.last_turn == q.first_turn for p, q in zip(known, known[1:], strict=False))
    gaps = known[-1].last_turn - known[0].first_turn + 1 - sum(p.distinct for p in known) + same if known else 0
    spoken = [p for p in parts if p.last_initial is not None]
    across = sum(p.last_initial + q.first_initial not in ("su", "ua", "au") for p, q in zip(spoken, spoken[1:], strict=False))
    return gaps, *(sum(getattr(p, x) for p in parts) for x in ("blank", "duplicate", "truncated")), sum(p.illegal for p in parts) + across


def crossings(rows: DataFrame) -> tuple[dict, dict]:
    """For conversations that lie in several tasks: (task, conversation) to (entered, left, inserts at the end), and conversation to its
    report. The driver holds two rows a task."""
    found, groups = borders(rows), []
    for x in found:
        if groups and groups[-1][-1][2] and x[1] and groups[-1][-1][3].key == x[3].key:
            groups[-1].append(x)
        else:
            groups.append([x])
    through, reports = {}, {}
    for g in (g for g in groups if len(g) > 1):
        cost, ways, inserts = entries([x[4] for x in g])
        for k, (x, (p, q)) in enumerate(zip(g, ways, strict=True)):
            through[x[0], x[3].key] = (p, q, inserts * (k + 1 == len(g)))
        reports[g[0][3].key] = (*totals([x[3] for x in g]), cost)
    return through, reports


class Repair(NamedTuple):
    """reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. turns: conv_id, place (ascending in the
    repaired conversation), edit (K, R or I), role, text. free deletes the checkpoint that both read."""

    reports: DataFrame
    turns: DataFrame
    rows: DataFrame

    def free(self) -> None:
        forget(self.rows)


def repair(conversations: DataFrame, parts: int | None = None) -> Repair:
    """Counts of each conversation's faults, the cheapest edits, and the repaired turns, from conv_id, turn, role and text.

    Rows go by turn, nulls first, and within one turn by a digest of role and text. A null role or text counts as a blank. Rows with a null
    conv_id are one conversation. A repeated row is a duplicate, at the same turn too. If there is a column n_rows it says how often a row
    stands, and 0 keeps a conversation without rows of its own: zeros, an empty audit, the digest of an empty text. Other columns are
    not read; an empty table gives no conversation. Texts are dealt twice, once to count equal rows and once in order,
    over so many parts, or as many as their size asks for."""
    source = pick(conversations, "conv_id", "turn", "role", "text", *[c for c in conversations.columns if c == "n_rows"])
    n = F.col("n_rows").cast("long") if "n_rows" in source.columns else F.lit(1).cast("long")
    conv, turn, none = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(" ")
    there = F.when(n > 0, turn)
    flat = source.select(
        conv.isNotNull().cast("long").alias("a"), F.coalesce(conv, F.lit(0)).alias("c"), there.isNotNull().alias("t0"), F.coalesce(there, F.lit(0)).alias("t1"),
        F.when(n > 0, F.coalesce("role", none)).otherwise("").alias("role"), F.when(n > 0, F.coalesce("text", none)).otherwise("").alias("text"), n.alias("n"),
    )
    rows = in_order(counted(_KEY, flat), [*_KEY, "t0", "t1", "k"], "n", n=parts or partitions(conversations))
    rows = rows.select(*_KEY, "t0", "t1", "k", "role", "text", "n", "part")
    through, reports = crossings(rows)
    shared = rows.sparkSession.sparkContext.broadcast(through)

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, part, _ in parts_of(batches, True):
            if (way := shared.value.get((number, part.key))) is None:
                layer, parents, base = part.worked([0])
                cost, inserts, k = closed(layer)
                audit, out, _ = part.repaired(codes(parents, k), 0, inserts)
                yield number, part, (*totals([part]), cost + base), audit, out
            else:
                entered, left, inserts = way
                layer, parents, _ = part.worked([entered])
                k = next(k for k, x in enumerate(layer) if x[1] == left)
                audit, out, _ = part.repaired(codes(parents, k), entered, inserts)
                yield number, part, None, audit, out

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, own, audit, out in mended(batches):
            data = "\n".join(f"{r}:{t}" for _, r, t in out).encode("utf-8", "surrogatepass")
            whole = own is not None
            values = [*part.key, number, *(own or [None] * 6), audit, None if whole or not out else data, hashlib.sha256(data).hexdigest() if whole else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    names = ["a", "c", "part", *(x.split()[0] for x in _REPORT.split(", ")), "piece", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.string()]
    made = small(rows).mapInArrow(report, f"a long, c long, part int, {_REPORT}, piece binary, digest string")
    conv_id = F.when(F.col("a") == 1, F.col("c")).alias("conv_id")
    columns = [F.col(x.split()[0]) for x in _REPORT.split(", ")]
    whole = made
    if reports:
        made = cut(made)
        over = made.where("digest is null")
        known = rows.sparkSession.createDataFrame([(*key, *r) for key, r in reports.items()], "a long, c long, " + _REPORT.replace(", audit string", ""))
        audits = over.groupBy(*_KEY).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"])).alias("audit"))
        crossed = known.join(audits, _KEY).join(joined_pieces(over, _KEY, b"\n"), _KEY)
        whole = made.where("digest is not null").select(*_KEY, *columns, "digest").unionByName(crossed.select(*_KEY, *columns, "digest"))
    found = whole.select(conv_id, *columns, F.col("digest").alias("repaired_sha256"))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, _, _, out in mended(batches):
            n = len(out)
            cols = [[part.key[0]] * n, [part.key[1]] * n, [number << 40 | k for k in range(n)], *([x[k] for x in out] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 3, strict=True)], names=["a", "c", "place", "edit", "role", "text"])

    given = small(rows).mapInArrow(turns, "a long, c long, place long, edit string, role string, text string")
    return Repair(found, given.select(conv_id, "place", "edit", "role", "text"), rows)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by crc32 of "conv_id:turn" modulo 20, nulls as one space: 0 drops a row, 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 gives it to the user. n_rows says how often a row stands."""
    source, none = pick(conversations, "conv_id", "turn", "role", "text"), F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none))
    code, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", none)
    return source.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce("role", none)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n_rows"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).reports


def _moves() -> str:
    """The macro edits as rows for SQL: (state, code, kind, initial or null, state after it, cost, roles inserted)."""
    out = []
    for p in STATES:
        state, made = p, []
        for k in range(RUN + 1):
            run, roles = "I" * k, "[" + ", ".join(f"'{ROLES[r]}:'" for r in made) + "]::varchar[]"
            out.append(f"({p}, '{run}D', 'D', null, {state}, {INSERT * k + DELETE}, {roles}, null)")
            out += [f"({p}, '{run}K', 'K', '{i}', {to}, {INSERT * k + KEEP}, {roles}, null)" for i, to in STEPS[state].items()]
            i = inserted(state)
            out.append(f"({p}, '{run}R', 'R', null, {STEPS[state][i]}, {INSERT * k + REROLE}, {roles}, '{ROLES[i]}')")
            state = STEPS[state][i]
            made.append(i)
    return ", ".join(out)


#: CRC-32 of texts of ASCII letters in SQL: its table follows from the polynomial.
CRC_TABLE = """crc_table as (select list(v order by i) as crc_of from (select i, list_reduce(list_prepend(i, range(8)), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as v from range(256) r(i)))"""


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)), lambda x, y: xor(x // 256, crc_of[(xor(x, y) % 256 + 1)::integer])), 4294967295)"


OP11_SQL = rf"""with recursive {CRC_TABLE},
 hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations, crc_table),
 damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) from hit),
 placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from damaged),
 judged as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
 turns as (select coalesce(conv_id, -1) as c, conv_id is null as a, i, role, text, blank, again and not blank as duplicate, cut and not again and not blank as truncated, turn, before || left(role, 1) not in ('su', 'ua', 'au') as illegal from judged),
 moves(p, code, kind, initial, q, cost, made, to_role) as (values {_moves()}),
 best(c, a, i, q, cost, audit, made) as (select distinct coalesce(conv_id, -1), conv_id is null, 0::bigint, 0, 0::bigint, '', []::varchar[] from conversations union all
  select c, a, i, q, (min(x)).cost, (min(x)).audit, (min(x)).made from (select b.c, b.a, t.i, m.q, struct_pack(cost := b.cost + m.cost + case when t.truncated and m.kind <> 'D' then {TRUNCATED} else 0 end, audit := b.audit || m.code,
    made := list_concat(b.made, m.made, case m.kind when 'D' then []::varchar[] when 'K' then [t.role || ':' || t.text] else [m.to_role || ':' || t.text] end)) as x
   from best b join turns t on t.c = b.c and t.a = b.a and t.i = b.i + 1 join moves m on m.p = b.q and (m.kind = 'D' or not (t.blank or t.duplicate)) and (m.initial is null or m.initial = left(t.role, 1))) group by c, a, i, q),
 last as (select c, a, max(i) as i from best group by 1, 2),
 ended as (select b.c, b.a, min(struct_pack(cost := b.cost + e.n * {INSERT}, audit := b.audit || repeat('I', e.n), made := list_concat(b.made, e.made))) as x
  from best b join last using (c, a, i) join (values (0, 0, []::varchar[]), (1, 2, ['user:', 'assistant:']), (2, 1, ['assistant:']), (3, 0, []::varchar[])) e(q, n, made) using (q) group by 1, 2),
 counts as (select c, a, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal from turns group by 1, 2)
 select case when not a then c end as conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  x.cost::bigint as cost, x.audit as audit, sha256(array_to_string(x.made, chr(10))) as repaired_sha256 from ended left join counts using (c, a)"""
