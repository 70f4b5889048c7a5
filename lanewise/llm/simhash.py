"""SimHash near-duplicates by a binary trie self-join.

The distinct 64-bit fingerprints form a binary trie, and the walk goes through pairs of its nodes together: it adds up the bits in
which the two nodes' prefixes differ and leaves a pair once they exceed the budget. Two fingerprints that differ in at most two bits
agree on one of three blocks of the bits, so there are three tries, each with another block's bits on top, and no walk needs to spend
a bit within the top block: the subtrees below a short prefix can be dealt to tasks with one copy of a fingerprint for each trie. A
subtree with more fingerprints than a task should hold is dealt as pairs of the subtrees below it whose prefixes are within the budget.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, forget, fresh, join_hot, pick, ready, table

#: Maps A-Z to a-z, every other byte to itself.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUDGET = 2
#: Bits on top of a trie within which no bit is spent: 64 bits hold BUDGET + 1 such blocks. How far each trie's bits are rotated.
TOP, TURNS = 21, (0, 22, 43)
#: Levels below which subtrees are dealt, and levels below TOP whose pairs of subtrees are dealt where a subtree is large.
DEALT, DEEPER = 16, 8
#: Fingerprints in a subtree that one task walks as a whole (16 MB), and pairs of nodes that a task walks at once.
SUBTREE, AT_ONCE = 2_000_000, 1 << 18


def shingle_hashes(parts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if parts else [], np.uint64)
    # One pass over the joined text: a shingle is the slice from its first word's start to its last word's end.
    ends = list(itertools.accumulate(map((1).__add__, map(len, parts))))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without any."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text: the majority of the bits of XXH64 over its shingles, repeats included."""
    return majority(shingle_hashes((text or b"").translate(LOWER).split(), words, seed))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint of each row's whole text as a signed number. No words, or a null text: zero."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column(0), "fp": [signed(simhash(t, words, seed)) for t in batch.column(1).to_pylist()]}

    docs = pick(docs, "doc_id", "text")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), rows, "doc_id long, fp long")


_HIGH = np.array([0, *[(1 << 64) - (1 << 64 - k) for k in range(1, 65)]], np.uint64)


def first_bit(x: np.ndarray) -> np.ndarray:
    """The level of the first bit set, 64 for none."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return 64 - np.bitwise_count(x).astype(np.int64)


class Walk:
    """The walk over pairs of nodes of a trie of distinct values. A node is a range of the values, which ascend within each root; the levels
    on which all values of both nodes agree among themselves are passed at once. visited and pruned count pairs of nodes."""

    def __init__(self, values: np.ndarray, budget: int = BUDGET, top: int = TOP, at_once: int = AT_ONCE):
        self.values, self.budget, self.top, self.at_once = values, budget, np.uint64(64 - top), at_once
        self.visited = self.pruned = 0

    def branches(self, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Where the right children of nodes that branch on a level begin."""
        bit = np.uint64(1) << (63 - level).astype(np.uint64)
        lo, hi = lo.copy(), hi - 1  # the first value lies left, the last one right
        while (open_ := hi - lo > 1).any():
            mid = (lo + hi) >> 1
            right = (self.values[mid] & bit) != 0
            hi = np.where(open_ & right, mid, hi)
            lo = np.where(open_ & ~right, mid, lo)
        return hi

    def close(self, roots: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of the pairs of values within the budget, in batches of two rows. roots has a row of a's range and b's range for each
        pair of roots; a root paired with itself gives each pair of its values once."""
        stack = [roots.T.copy()]
        while stack:
            now = stack.pop()
            if now.shape[1] > self.at_once:
                stack.append(now[:, self.at_once :])
                now = now[:, : self.at_once]
            self.visited += now.shape[1]
            alo, ahi, blo, bhi = now
            v = self.values
            a, b = v[alo], v[blo]
            la, lb = first_bit(a ^ v[ahi - 1]), first_bit(b ^ v[bhi - 1])
            level = np.minimum(la, lb)
            differ = (a ^ b) & _HIGH[level]
            ok = (np.bitwise_count(differ) <= self.budget) & (differ >> self.top == 0)
            self.pruned += int((~ok).sum())
            itself = alo == blo
            leaves = ok & (level == 64)
            if (found := leaves & ~itself).any():
                yield np.stack([alo[found], blo[found]])
            go = ok & ~leaves
            if not go.any():
                continue
            alo, ahi, blo, bhi, la, lb, level, itself = (x[go] for x in (alo, ahi, blo, bhi, la, lb, level, itself))
            in_a, in_b = la == level, lb == level
            am, bm = ahi.copy(), bhi.copy()
            am[in_a] = self.branches(alo[in_a], ahi[in_a], level[in_a])
            bm[in_b] = self.branches(blo[in_b], bhi[in_b], level[in_b])
            left_a, right_a, left_b, right_b = (alo, am), (am, ahi), (blo, bm), (bm, bhi)
            children = [(left_a, left_b, None), (right_a, right_b, in_a & in_b), (left_a, right_b, in_b), (right_a, left_b, in_a & ~itself)]
            stack.append(np.concatenate([np.stack([*x, *y]) if take is None else np.stack([*x, *y])[:, take] for x, y, take in children], axis=1))


def forest(walk: Walk, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that connect what the walk's pairs connect, at most one less than the values."""
    parent = np.arange(len(walk.values))
    links = []
    for pairs in walk.close(roots):
        while True:
            up = parent[pairs]
            if (up == parent[up]).all():
                break
            parent = parent[parent]
        for a, b in pairs.T[up[0] != up[1]].tolist():
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
    return links


def deal(prints: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(trie, prefix, pair, side, v) from distinct fingerprints fp: v is the fingerprint with the trie's block on top, rows of one
    (trie, prefix, pair) are walked by one task; side 1 is paired with side 0, a pair of one side with itself. The driver reads the
    prefixes of the large subtrees only, of which there are at most 3 / subtree of the fingerprints."""
    turned = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("trie"), _turn("fp", t).alias("v")) for k, t in enumerate(TURNS)]))
    each = prints.select(turned.alias("x")).select("x.trie", F.shiftrightunsigned("x.v", 64 - DEALT).cast("int").alias("prefix"), "x.v")
    large = [tuple(r) for r in each.groupBy("trie", "prefix").count().where(F.col("count") > subtree).select("trie", "prefix").collect()]
    plain = each.select("trie", "prefix", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("byte").alias("side"), "v")
    if not large:
        return plain
    heavy = F.broadcast(prints.sparkSession.createDataFrame(large, "trie byte, prefix int"))
    masks = [m for m in range(1 << DEEPER) if m.bit_count() <= BUDGET]
    part = F.shiftrightunsigned("v", 64 - TOP - DEEPER).cast("long")
    split = each.join(heavy, ["trie", "prefix"]).select("trie", "prefix", "v", part.alias("own"), F.explode(F.array(*map(F.lit, masks))).alias("m"))
    split = split.withColumn("other", F.col("own").bitwiseXOR(F.col("m").cast("long")))
    pair = F.least("own", "other") * F.lit(1 << DEEPER) + F.greatest("own", "other") % F.lit(1 << DEEPER) + 1
    return plain.join(heavy, ["trie", "prefix"], "left_anti").unionByName(split.select("trie", "prefix", pair.alias("pair"), (F.col("own") > F.col("other")).cast("byte").alias("side"), "v"))


def _turn(name: str, by: int):
    return F.col(name) if not by else F.shiftleft(name, by).bitwiseOR(F.shiftrightunsigned(name, 64 - by))


def roots_of(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows of (a's range, b's range) from keys and sides in ascending order."""
    starts = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1) | (side[1:] != side[:-1])]))[0]
    ends = np.append(starts[1:], len(side))
    first = np.append(True, (key[starts[1:]] != key[starts[:-1]]).any(axis=1)) if len(starts) > 1 else np.array([True])
    two = np.append(~first[1:], False)  # a range of side 1 follows
    pair = key[starts, 2] - 1
    lone = first & ~two & (ends - starts > 1) & ((pair < 0) | ((pair >> DEEPER ^ pair) & ((1 << DEEPER) - 1) == 0))
    rows = [np.stack([starts[lone], ends[lone], starts[lone], ends[lone]], axis=1)]
    at = np.nonzero(two)[0]
    rows.append(np.stack([starts[at], ends[at], starts[at + 1], ends[at + 1]], axis=1))
    return np.concatenate(rows)


def links(prints: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within the budget, a spanning forest for each task: fingerprints that links
    connect are connected, and the rows stay in proportion to the fingerprints."""
    ready(prints.sparkSession)

    def run(batches):
        parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] for batch in batches if batch.num_rows]
        if not parts:
            return
        trie, prefix, pair, side, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        v = v.view(np.uint64)
        order = np.lexsort((v, side, pair, prefix, trie))
        trie, prefix, pair, side, v = (x[order] for x in (trie, prefix, pair, side, v))
        found = forest(Walk(v), roots_of(np.stack([trie, prefix, pair], axis=1).astype(np.int64), side))
        if found:
            at = np.array(found).T
            by = np.array([64 - t for t in TURNS], np.uint64)[trie[at[0]]]
            a, b = (x << by % np.uint64(64) | np.where(by == 64, np.uint64(0), x >> (np.uint64(64) - by) % np.uint64(64)) for x in v[at])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return deal(prints, subtree).repartition("trie", "prefix", "pair").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): root is the least node reachable.

    Alternating star contraction: each node's larger neighbours are tied to its least neighbour, then each node's smaller ones are,
    until nothing changes. Each round's edges go to the checkpoint folder, and the round's before it are deleted; only counts and sums
    come to the driver. A node with very many neighbours makes a skewed join, which adaptive execution splits.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        forget(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def grouped(prints: DataFrame, order: str = "doc_id", subtree: int = SUBTREE) -> DataFrame:
    """The rows of prints (fp and the column order) with component_id: the least value of order that links reach, nulls last."""
    nodes = cut(prints.groupBy("fp").agg(F.min(order).alias("least"), F.count("*").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    rooted = nodes.join(components(links(nodes.select("fp"), subtree)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids, "root").select("fp", "n", "component_id"))
    return join_hot(prints, named, ["fp"], total).drop("n")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, subtree: int = SUBTREE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: component_id is the least doc_id that links reach, the row's own included.

    Fingerprints link at 2 or fewer differing bits. Empty and null texts have fingerprint zero and link like any other. Rows that
    repeat a doc_id count each by its own text. A row with a null doc_id has its component's least id, null if no other row has one.
    Other columns are not read; an empty table gives none.
    """
    found = grouped(cut(fingerprints(docs, words, seed)), "doc_id", subtree)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the least doc_id, ids before nulls, of several the first read."""
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))

    def prints(batch: pa.RecordBatch) -> dict[str, list]:
        return {"row": batch.column(0), "doc_id": batch.column(1), "fp": [signed(simhash(t, words, seed)) for t in batch.column(2).to_pylist()]}

    own = arrow_map(pick(rows, row, "doc_id", "text").select(row, F.col("doc_id").cast("long"), F.col("text").cast("binary")), prints, "row long, doc_id long, fp long")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    kept = grouped(cut(own.select("fp", order.alias("place"))), "place").select("component_id.row").distinct().withColumnRenamed("row", row)
    return rows.join(kept, row, "left_semi").drop(row)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
