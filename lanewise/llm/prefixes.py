"""The prefix trie of conversations by partition refinement.

All conversations start as one class. Turn after turn each active class is split by its members' next turn; a class of one member is
retired, its remaining turns following as a chain that nothing branches from, and so is a member that has no further turn. Sums over
subtrees are folded back afterwards, from the last split to the first. A node is known by its least member and its depth.

A class with many turns to come is split by a shuffle a turn; one with CLASS_ROWS turns at most is dealt to a task, which refines it to
the end. So the rounds of shuffles are as many as there are turns that large classes share, not as long as the longest shared beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_hot, partitions, pick, small, table, written
from .ordered import in_order, numbered, ordered_digests
from .repair import CRC_TABLE, crc_sql

#: Turns to come of a class that one task refines.
CLASS_ROWS = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1 on), k (a digest of role and text) and words of each turn of conversations (conv_id, turn, role, text).

    Turns go by turn, nulls first, then by that digest; a null role or text is empty; a repeated row is a repeated turn; rows without a
    conv_id belong to no conversation and are left out."""
    source, none = pick(conversations, "conv_id", "turn", "role", "text"), F.lit("")
    role, text = F.coalesce("role", none), F.coalesce("text", none)
    turn = F.col("turn").cast("long")
    rows = source.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), turn.isNotNull().alias("t0"), F.coalesce(turn, F.lit(0)).alias("t1"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("k"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    # The row's number keeps equal rows apart, so that many of them are dealt like others.
    return numbered(in_order(rows, ["conv", "t0", "t1", "k", "row"], n=partitions(conversations)), "conv", "pos").select("conv", "pos", "k", "words")


def refined(top: int, depth: int, members: list[tuple[int, list[tuple[bytes, int]]]]) -> list[list]:
    """The nodes [least member, depth, its parent's, members, children, leaves, saved tokens, members that end] of the trie below a class,
    whose members (id, further turns) come by id and have a turn each. The first one is the class itself, with what is below it only."""
    nodes, ups = [[top, depth, None, len(members), 0, 0, 0, []]], [0]
    active, d = [(0, members)], 0
    while active:
        after = []
        for at, own in active:
            parts: dict[bytes, list] = {}
            for m in own:
                if len(m[1]) > d:
                    parts.setdefault(m[1][d][0], []).append(m)
            for part in parts.values():
                conv, turns = part[0]
                nodes.append([conv, depth + d + 1, nodes[at][0], len(part), 0, 0, (len(part) - 1) * turns[d][1], [c for c, t in part if len(t) == d + 1]])
                ups.append(at)
                if len(part) > 1:
                    after.append((len(nodes) - 1, part))
                    continue
                for e in range(d + 1, len(turns)):  # a single member's tail
                    ups.append(len(nodes) - 1)
                    nodes.append([conv, depth + e + 1, conv, 1, 0, 0, 0, [conv] if e + 1 == len(turns) else []])
        active, d = after, d + 1
    for k in range(len(nodes) - 1, 0, -1):  # children stand behind their parents
        node, up = nodes[k], nodes[ups[k]]
        node[5] = node[5] or 1
        up[4] += 1
        up[5] += node[5]
        up[6] += node[6]
    return nodes


def refined_in_tasks(turns: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """The nodes below small classes, from their members (conv, cls, at: the class's depth). A class itself comes with a null n_convs and
    what its children add up to."""
    rows = turns.join(classes, "conv").where("depth > at").select("cls", "at", "conv", "depth", "k", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []

        def ended() -> None:
            nodes = refined(*now, members)
            nodes[0][3] = None
            out.extend((*x[:7], hashlib.sha256(",".join(map(str, x[7])).encode()).hexdigest()) for x in nodes)

        for batch in batches:
            for cls, at, conv, k, words in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True):
                if (cls, at) != now:
                    if now is not None:
                        ended()
                    now, members = (cls, at), []
                if not members or members[-1][0] != conv:
                    members.append((conv, []))
                members[-1][1].append((k, words))
            if out:
                yield nodes_of(out)
                out.clear()
        if now is not None:
            ended()
            yield nodes_of(out)

    dealt = rows.repartition(n, "cls", "at").sortWithinPartitions("cls", "at", "conv", "depth")
    return small(dealt).mapInArrow(run, _NODE)


def nodes_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def prefix_trie(turns: DataFrame, convs: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """The nodes of the trie of conversations: conv_id (the least member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (words that members after the first share, summed over the subtree) and ends_sha256 (of the ids, ascending and
    comma-joined, of members that end there).

    turns: conv, depth (1, 2, ... without a gap), k (equal for equal turns) and words; convs: conv and len (its number of turns, 0 too).
    Without conversations there is no node, not even the root."""
    n = partitions(turns)
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n"), F.max("len").alias("len"), F.sum("len").alias("rest"))
    groups = written(whole.where("n > 0").select(F.lit(None).cast("long").alias("parent"), "conv_id", "n", "len", "rest", F.lit(0).cast("long").alias("words")))
    root, members, _, rest = whole.first()
    moved = convs.select("conv", *[F.lit(x).cast("long").alias(k) for k, x in (("cls", root), ("n", members), ("rest", rest))], "len")
    d, levels, ends, classes = 0, [groups], [], []
    while True:
        held = moved.where("n > 1")
        ends.append(held.where(F.col("len") == d).select("cls", F.lit(d).cast("long").alias("depth"), "conv"))
        classes.append(held.where((F.col("len") > d) & (F.col("rest") <= class_rows)).select("conv", "cls", F.lit(d).cast("long").alias("at")))
        active = held.where((F.col("len") > d) & (F.col("rest") > class_rows)).select("conv", "cls", "len")
        if active.isEmpty():
            break
        d += 1
        step = written(active.join(turns.where(F.col("depth") == d).select("conv", "k", "words"), "conv"))
        parts = step.groupBy("cls", "k").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n"), F.max("len").alias("len"), F.sum(F.col("len") - d).alias("rest"), F.first("words").alias("words"))
        parts = written(parts)
        moved = written(join_hot(step.drop("words"), parts.select("cls", "k", "conv_id", "n", "rest"), ["cls", "k"], step.count()).select("conv", F.col("conv_id").alias("cls"), "n", "rest", "len"))
        forget(step)
        levels.append(parts.select(F.col("cls").alias("parent"), "conv_id", "n", "len", "rest", "words"))

    inner = written(refined_in_tasks(turns, united(classes), n))
    alone = united([x.where((F.col("n") == 1) & (F.col("len") > k)).select(F.col("conv_id").alias("conv"), F.lit(k).cast("long").alias("at"), "len") for k, x in enumerate(levels)])
    own = F.sha2(F.col("conv").cast("string"), 256)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = turns.select("conv", "depth").join(alone, "conv").where("depth > at").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), own).otherwise(EMPTY).alias("ends_sha256"),
    )

    # Fold back: what a class's parts add up to, level by level.
    known = inner.where("n_convs is null").select("conv_id", F.col("depth").alias("at"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    found: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        below = known.where(F.col("at") == k).drop("at")
        if found:
            below = below.unionByName(found[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
        single = F.col("n") == 1
        found.append(written(levels[k].join(below, "conv_id", "left").select(
            "conv_id", F.lit(k).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(single, (F.col("len") > k).cast("long")).otherwise(F.coalesce("children", none)).alias("n_children"), F.when(single, one).otherwise(F.coalesce("leaves", one)).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", none)).alias("saved_tokens"), F.when(single & (F.col("len") == k), F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_one"),
        )))
    digests = ordered_digests(united(ends), ["cls", "depth"], "conv").withColumnRenamed("cls", "conv_id")
    shared = united(found).join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_one", "digest", F.lit(EMPTY))).drop("ends_one", "digest")
    return shared.unionByName(tails).unionByName(inner.where("n_convs is not null"))


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and convs of conversations as they are, for prefix_trie."""
    turns = written(turns_in_order(conversations).withColumnRenamed("pos", "depth"))
    return turns, written(turns.groupBy("conv").agg(F.max("depth").alias("len")))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """turns and convs of rebuilt conversations: c gets the first h turns of conversation c - c % group, then its own after its first h, where h
    is crc32 of c in decimal modulo most."""
    turns = written(turns_in_order(conversations))
    c, h = F.col("conv"), F.crc32(F.col("conv").cast("string").cast("binary")) % most
    lens = turns.groupBy("conv").agg(F.max("pos").alias("own")).select("conv", "own", h.alias("h"), (c - c % group).alias("base"))
    lens = written(lens)
    given = lens.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = written(lens.join(given, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0).cast("long")))).select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("len")))
    first = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "k", "words")
    taken = convs.where("m > 0").join(first, "base").where("depth <= m").select("conv", "depth", "k", "words")
    rest = turns.where(F.col("pos") > h).join(convs.select("conv", "m", "h"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "k", "words")
    return written(taken.unionByName(rest)), convs.select("conv", "len")


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = rf"""with {CRC_TABLE},
 placed as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
 convs as (select c, c - c % 20 as b, {crc_sql("c::varchar")} % 4 as h from (select distinct c from placed), crc_table),
 given as (select convs.c, p.pos as depth, p.role, p.text from convs join placed p on p.c = convs.b and p.pos <= convs.h),
 taken as (select c, count(*) as m from given group by 1),
 turns as (select * from given union all select p.c, p.pos - h + coalesce(m, 0), p.role, p.text from placed p join convs using (c) left join taken using (c) where p.pos > h),
 begun as (select c, depth, len(regexp_extract_all(text, '{WORD}')) as words, list(sha256(length(role) || ':' || role || text)) over (partition by c order by depth) as prefix from turns),
 member as (select c, depth, words, min(c) over (partition by depth, prefix) as node from begun union all select c, 0, 0, min(c) over () from convs),
 nodes as (select node, depth, count(*) as n, (count(*) - 1) * max(words) as saved from member group by 1, 2),
 linked as (select x.*, m.node as parent from nodes x left join member m on m.c = x.node and m.depth = x.depth - 1),
 children as (select parent as node, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by 1, 2),
 sums as (select m.node, m.depth, sum(x.saved) as saved, count(*) filter (k.node is null) as leaves from nodes x join member m on m.c = x.node and m.depth <= x.depth left join children k on k.node = x.node and k.depth = x.depth group by 1, 2),
 lens as (select c, max(depth) as depth from member group by 1),
 ended as (select m.node, m.depth, string_agg(m.c::varchar, ',' order by m.c) as ids from member m join lens using (c, depth) group by 1, 2)
 select x.node as conv_id, x.depth::bigint as depth, x.parent as parent_conv_id, x.n::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children, leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
 from linked x join sums s using (node, depth) left join children using (node, depth) left join ended using (node, depth)"""
