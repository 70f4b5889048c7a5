"""Chat formatting as a prefix tree: conversations that begin alike share their first turns' tokens.

A node is a turn in its context. Each node's tokens are emitted once, depth first over the whole table, and each node carries the
position of its first token in its conversation, its offset in the emission and the emitted ranges of the ancestors it attends to.

No row holds its ancestors. The tree is cut into branches: a branch goes on from a node to the child that most conversations share,
all other children begin branches of their own, and so do the turns of one conversation alone. A branch is emitted as one run,
followed by those that leave it, the deepest first. A conversation crosses no more branches than the logarithm of their number, so its
path is a short list of them; a branch's place follows from sorting such paths, and positions, offsets and ranges from prefix sums.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import bucketed

from . import bpe
from .common import cut, join_hot, partitions, pick, small, table

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
_ESCAPE = re.compile(r"\\|### |: |</turn>")
_READ = re.compile(r"\\(\\|### |: |</turn>)|(### )|(: )|(</turn>)")
LEARNED_ROLE = "assistant"
#: A conversation: its id, 0 for a null one, and whether the id is null.
CONV = ["c", "a"]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """Opening mark with the role, text, closing mark: tokens never cross their borders."""
    return OPEN + escape(role) + COLON, escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, role, part, at = [], None, [], 0
    for m in _READ.finditer(formatted):
        part.append(formatted[at : m.start()])
        at = m.end()
        if m[1]:
            part.append(m[1])
        elif m[2]:
            part, role = [], None
        elif m[3]:
            role, part = "".join(part), []
        else:
            turns.append((role, "".join(part)))
            part = []
    return turns


class Tree(NamedTuple):
    """nodes: key, parent, depth, tokens (ids packed as little-endian unsigned 32-bit integers), n_tokens, loss_from and loss_to (token
    range of an assistant's text), position (of the first token; those of the others follow), emitted (offset of the first token),
    attends (array of {lo, hi}, the emitted ranges of the ancestors, hi exclusive, touching ones merged; inside a node attention is
    causal), and the conversation (c, a) whose branch holds it. leaves: conv_id, n_turns, and the conversation (c, a) that stands for all
    with the same turns. paths: for each such conversation the pieces of branches from the root to its last turn, by depth: first,
    until (turns, exclusive), position, size (tokens), offset, and the branch's conversation (oc, oa)."""

    nodes: DataFrame
    leaves: DataFrame
    paths: DataFrame
    buckets: int


_TURNS = "c long, a boolean, depth int, k1 long, k2 long, p1 long, p2 long, tokens binary, n_tokens int, loss_from int, loss_to int, position long, last boolean"
_TYPES = [pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 4, pa.binary(), *[pa.int32()] * 3, pa.int64(), pa.bool_()]


def encoded_turns(conversations: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Each turn with its tokens and the key of its prefix (k1, k2; that of the prefix before it p1, p2), in buckets by conversation, and
    the number of buckets. A conversation's turns pass one task in order, a batch at a time."""
    shared = conversations.sparkSession.sparkContext.broadcast(bpe.load(path))
    source = pick(conversations, "conv_id", "turn", "role", "text")
    conv, none = F.col("conv_id").cast("long"), F.lit("")
    turns = source.select(F.coalesce(conv, F.lit(0)).alias("c"), conv.isNull().alias("a"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    n = partitions(turns)
    dealt = turns.repartition(n, *CONV).sortWithinPartitions(*CONV, F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        e, held = bpe.encoder(shared.value), None
        for batch in batches:
            c, a, _, role, text = (x.to_pylist() for x in batch.columns)
            parts = e.encode_many([s for r, t in zip(role, text, strict=True) for s in segments(r, t)])
            out = []
            for k, (own, r, t) in enumerate(zip(zip(c, a, strict=True), role, text, strict=True)):
                head, body, tail = parts[3 * k : 3 * k + 3]
                if held and held[:2] == own:
                    depth, up, at, last = held[2] + 1, held[-1], held[11] + held[8], False
                else:
                    depth, up, at, last = 0, bytes(16), 0, True
                if held:
                    out.append((*held[:-1], last))
                key = hashlib.sha256(up + len(r).to_bytes(8, "big") + (r + t).encode()).digest()[:16]
                learned = r == LEARNED_ROLE
                held = (*own, depth, *halves(key), *halves(up), head + body + tail, (len(head) + len(body) + len(tail)) // 4, len(head) // 4 * learned, (len(head) + len(body)) // 4 * learned, at, key)
            if out:
                yield as_batch(out)
        if held:
            yield as_batch([(*held[:-1], True)])

    return bucketed(small(dealt).mapInArrow(run, _TURNS), n, *CONV), n


def halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in _TURNS.split(", ")])


def whole(high: str, low: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def tops_of(turns: DataFrame, distinct: DataFrame, total: int) -> DataFrame:
    """c, a, n_turns, total and tops of each distinct conversation: the nodes (depth, position, k1, k2) on its path that begin a branch."""
    slim = turns.select(*CONV, "depth", "k1", "k2", "p1", "p2", "position").join(distinct.select(*CONV), CONV, "left_semi")
    shared = slim.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth")).where("n > 1")
    shared = cut(shared)
    heavy = shared.where("depth > 0").groupBy("p1", "p2").agg(F.max(F.struct("n", "k1", "k2")).alias("most")).select("most.k1", "most.k2", F.lit(False).alias("top"))
    marked = cut(shared.select("k1", "k2", "n").join(heavy, ["k1", "k2"], "left").withColumn("top", F.coalesce("top", F.lit(True))))
    crossed = join_hot(slim.select(*CONV, "depth", "k1", "k2", "position"), marked, ["k1", "k2"], total)
    top = F.struct("depth", "position", "k1", "k2")
    begun = crossed.groupBy(*CONV).agg((F.max("depth") + 1).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("top"), top))).alias("tops"))
    known = cut(distinct.join(begun, CONV, "left").withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("tops", F.coalesce("tops", F.expr("cast(array() as array<struct<depth:int,position:bigint,k1:bigint,k2:bigint>>)"))))
    tails = slim.join(known.where("alone < n_turns").select(*CONV, F.col("alone").alias("at")), CONV).where("depth = at").select(*CONV, top.alias("tail"))
    return known.join(tails, CONV, "left").select(*CONV, "n_turns", "total", F.when(F.col("tail").isNull(), F.col("tops")).otherwise(F.concat("tops", F.array("tail"))).alias("tops"))


def placed(branches: DataFrame) -> DataFrame:
    """branches (path, size) with offset: the sizes of those before it by path. One row of each shard comes to the driver."""
    spark = branches.sparkSession
    dealt = cut(branches.repartitionByRange(partitions(branches, 1 << 20), "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id()))
    start, at = {}, 0
    for shard, size in dealt.groupBy("shard").agg(F.sum("size")).orderBy("shard").collect():
        start[shard], at = at, at + size
    state = spark.sparkContext.broadcast(start)

    def run(batches):
        at = {}
        for batch in batches:
            sizes, shards = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for size, s in zip(sizes, shards, strict=True):
                out.append(at.setdefault(s, state.value[s]))
                at[s] += size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["k1", "k2", "offset"])

    return dealt.select("k1", "k2", "size", "shard").mapInArrow(run, "k1 long, k2 long, offset long")


def prefix_tree(conversations: DataFrame, path: str | None = None) -> Tree:
    """The prefix tree of conversations (conv_id, turn, role, text).

    Turns are ordered by turn, role, text, nulls first; null roles and texts are empty; rows with a null conv_id are one conversation;
    repeated rows are repeated turns; an empty table has no nodes. Other columns are not read."""
    turns, n = encoded_turns(conversations, path or bpe.default_path())
    ends = turns.where("last").select(*CONV, "k1", "k2", (F.col("depth") + 1).cast("long").alias("n_turns"), (F.col("position") + F.col("n_tokens")).alias("total"))
    firsts = cut(ends.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("a", "c")).alias("by"), F.min("n_turns").alias("n_turns"), F.min("total").alias("total")))
    n_rows, n_convs = firsts.agg(F.sum("n_turns"), F.sum("n")).first()
    stands = firsts.select("k1", "k2", "n", F.col("by.c").alias("leaf_c"), F.col("by.a").alias("leaf_a"))
    leaves = join_hot(ends.select(*CONV, "k1", "k2", "n_turns"), stands, ["k1", "k2"], n_convs or 0)
    leaves = leaves.select(F.when(~F.col("a"), F.col("c")).alias("conv_id"), "n_turns", F.col("leaf_c").alias("c"), F.col("leaf_a").alias("a"))

    convs = tops_of(turns, firsts.select(F.col("by.c").alias("c"), F.col("by.a").alias("a"), "n_turns", "total"), n_rows or 0)
    piece = "struct(x.depth as first, coalesce(tops[i + 1].depth, n_turns) as until, x.position as position, coalesce(tops[i + 1].position, total) - x.position as size, x.k1 as k1, x.k2 as k2, transform(slice(tops, 1, i + 1), y -> struct(-y.depth as up, y.k1 as k1, y.k2 as k2)) as path)"
    pieces = cut(convs.select(*CONV, F.expr(f"inline(transform(tops, (x, i) -> {piece}))".replace("tops[i + 1]", "get(tops, i + 1)"))))
    longest = F.max(F.struct("until", "c", "a", "size", "path")).alias("m")
    branches = cut(pieces.groupBy("k1", "k2").agg(F.count("*").alias("n"), longest).select("k1", "k2", "n", F.col("m.c").alias("oc"), F.col("m.a").alias("oa"), F.col("m.size").alias("size"), F.col("m.path").alias("path")))
    offsets = branches.select("k1", "k2", "n", "oc", "oa").join(placed(branches.select("k1", "k2", "size", "path")), ["k1", "k2"])
    n_pieces = branches.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(pieces.drop("path"), cut(offsets), ["k1", "k2"], n_pieces)
    paths = cut(joined.groupBy(*CONV).agg(F.array_sort(F.collect_list(F.struct("first", "until", "position", "size", "offset", "oc", "oa"))).alias("pieces")))

    # A conversation's own pieces are emitted with it; a left join keeps the buckets.
    own = F.expr("element_at(filter(pieces, x -> x.first <= depth), -1)")
    attends = F.expr("""aggregate(concat(transform(filter(pieces, x -> x.first < own.first), x -> struct(x.offset as lo, x.offset + x.size as hi)), array(struct(own.offset as lo, emitted as hi))),
        cast(array() as array<struct<lo:bigint,hi:bigint>>),
        (s, x) -> if(x.lo = x.hi, s, if(size(s) > 0 and element_at(s, -1).hi = x.lo, concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).lo as lo, x.hi as hi))), concat(s, array(x)))))""")
    held = turns.join(paths, CONV, "left").where("pieces is not null").withColumn("own", own).where("own.oc = c and own.oa = a").withColumn("emitted", F.expr("own.offset + position - own.position"))
    nodes = held.select(*CONV, whole("k1", "k2").alias("key"), F.when(F.col("depth") > 0, whole("p1", "p2")).alias("parent"), "depth", "tokens", "n_tokens", "loss_from", "loss_to", "position", "emitted", attends.alias("attends"))
    return Tree(nodes, leaves, paths, n)


def gathered(tree: Tree) -> DataFrame:
    """to_c, to_a, depth, tokens, loss_from, loss_to: the nodes of each distinct conversation, its own ones where they are, the others asked for
    from the conversations that hold them. Where very many ask one conversation, its nodes are dealt in copies."""
    node = tree.nodes.select(*CONV, "depth", "tokens", "loss_from", "loss_to")
    asked = cut(tree.paths.select(*CONV, F.explode(F.expr("filter(pieces, x -> x.oc <> c or x.oa <> a)")).alias("x")).select(F.col("c").alias("to_c"), F.col("a").alias("to_a"), F.col("x.oc").alias("c"), F.col("x.oa").alias("a"), "x.first", "x.until"))
    per = asked.groupBy(*CONV).agg(F.count("*").alias("n"), F.max("until").alias("deepest"))
    total = asked.count()
    per = cut(per.withColumn("copies", F.ceil(F.col("n") * 1000 / F.lit(max(1, total))).cast("int")))
    given = node.join(per.select(*CONV, "deepest", "copies"), CONV).where("depth < deepest").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)"))).drop("deepest", "copies")
    wanted = join_hot(asked, per.select(*CONV, "n", "copies"), CONV, total).withColumn("copy", F.expr("cast(pmod(xxhash64(to_c, to_a), copies) as int)"))
    moved = given.join(wanted.select(*CONV, "copy", "to_c", "to_a", "first", "until"), [*CONV, "copy"]).where("depth >= first and depth < until")
    rest, to = ["depth", "tokens", "loss_from", "loss_to"], ["to_c", "to_a"]
    # Both sides are dealt alike, so the conversations' own nodes stay where they are; new names, since the planner compares qualified ones.
    n = tree.buckets
    own = node.select(F.col("c").alias("to_c"), F.col("a").alias("to_a"), *rest)
    return own.unionByName(moved.select(*to, *rest).repartition(n, *to)).repartition(n, *to).sortWithinPartitions(*to, "depth")


def read_back(tree: Tree, path: str | None = None) -> DataFrame:
    """conv_id, n_turns and digests of what the tree's tokens say: each distinct conversation's nodes pass one task from the root on, the
    template is parsed and unescaped. A conversation whose nodes are not all there, each once, fails the query."""
    spark = tree.nodes.sparkSession
    shared = spark.sparkContext.broadcast(bpe.load(path or bpe.default_path()))
    names = ["c", "a", "read", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        e, now = bpe.encoder(shared.value), None
        done: list[tuple] = []

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
            done.clear()
            return out

        def close():
            (c, a), turns, loss, read, learned, chars = now
            done.append((c, a, read, turns.hexdigest(), learned, loss.hexdigest(), chars))

        for batch in batches:
            for c, a, depth, tokens, lo, hi in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or now[0] != (c, a):
                    if now:
                        close()
                    now = [(c, a), hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                text = e.decode(tokens)
                turn = parse(text)
                if depth != now[3] or len(turn) != 1:
                    raise ValueError(f"turn {now[3]} of a conversation is not where the tree says: {c, depth, len(turn)}")
                now[1].update(f"{turn[0][0]}\n{turn[0][1]}\n".encode())
                loss = re.sub(r"\\(\\|### |: |</turn>)", r"\1", e.decode(tokens[4 * lo : 4 * hi]))
                now[2].update(loss.encode())
                now[3:] = now[3] + 1, now[4] + len(loss), now[5] + len(text)
            if done:
                yield batch_of()
        if now:
            close()
            yield batch_of()

    read = cut(small(gathered(tree)).mapInArrow(run, "c long, a boolean, read long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    per = cut(tree.leaves.groupBy(*CONV).agg(F.count("*").alias("n")).join(read, CONV, "left"))
    total = per.agg(F.sum("n")).first()[0] or 0
    out = join_hot(tree.leaves, per, CONV, total)
    whole_ = F.when(F.col("read").eqNullSafe(F.col("n_turns")), F.col("turns_sha256")).otherwise(F.raise_error(F.lit("a conversation's nodes are not all in the tree")))
    return out.select("conv_id", "n_turns", whole_.alias("turns_sha256"), "loss_chars", "loss_sha256", "formatted_chars")


#: The conversation that the query adds: its texts hold the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(prefix_tree(rows.unionByName(extra)))


OP1_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum(4 + 2 + 7 + length(regexp_replace(r, '(\\|### |: |</turn>)', '\\\1', 'g')) + length(regexp_replace(t, '(\\|### |: |</turn>)', '\\\1', 'g')))::bigint formatted_chars
from c group by conv_id"""
