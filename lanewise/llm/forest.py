"""Near-duplicates by an LSH forest over min-hash signatures, confirmed on the full shingle sets.

Each tree orders the signatures (128 min-hashes, a byte of each) by the same bytes in another sequence. Signatures that share a beginning
in that order are candidates, and how much they must share depends on the region: a beginning of four bytes is tried first. Within a region
of REGION or fewer all pairs are candidates. In a crowded one each member is compared with the most central one, which stands in the most
crowded regions of all trees: the text that the others are copies of. Where that leaves a region in several groups, the members outside the
largest group go on into regions of 8, 16, 32, 64 and all 128 bytes. What is still in several groups then is compared in full: every pair of
members of unlike groups, block by block in bounded memory, which is quadratic in such a region by nature but gives links only.

Two sets at 0.85 share a beginning of four bytes in none of 32 trees with a probability of 6e-11, and all that do are compared or connected by
others. Candidates whose signatures agree in fewer than 77 of 128 bytes (a pair at 0.85 agrees in 109, give or take 4) are dropped, all
others are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import bucketed

from .common import arrow_map, cut, forget, join_hot, partitions, pick, ready, small, table, written
from .prefixes import united
from .signatures import AGREE, HASHES, agreeing, shingles, signature, similar
from .simhash import components

WORDS, NEAR = 3, (85, 100)
TREES, REGION = 32, 32
#: Bytes of the beginnings, level by level.
DEPTHS = (4, 8, 16, 32, 64, 128)
#: Members of a hub that one copy of its text serves.
SERVED = 256
#: Members of a block of a crowd, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 1 << 12, 1 << 24
_G = np.random.default_rng(13)
#: Each tree's sequence of the signature's bytes.
ORDER = np.stack([_G.permutation(HASHES) for _ in range(TREES)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def first_spots(signs: list[bytes]) -> np.ndarray:
    """The number of each signature's beginning of four bytes in each tree, a row for each signature."""
    each = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, HASHES)[:, ORDER[:, : DEPTHS[0]]]
    heads = np.ascontiguousarray(each).view("<u4").reshape(-1, TREES).astype(np.uint64)
    return ((heads | np.arange(TREES, dtype=np.uint64) << np.uint64(32)) * _MIX).view(np.int64)


def spot(sign: np.ndarray, tree: int, level: int) -> int:
    h = xxhash.xxh3_64_intdigest(sign[ORDER[tree, : DEPTHS[level]]].tobytes(), tree * len(DEPTHS) + level)
    return h - (1 << 64) if h >> 63 else h


def planted(signs: DataFrame) -> DataFrame:
    """(tree, spot, node) of the first level, from node and sign."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        return {"node": batch.column(0), "spots": list(first_spots(batch.column(1).to_pylist()))}

    each = arrow_map(signs.select("node", "sign"), rows, "node long, spots array<long>").select("node", F.posexplode("spots").alias("tree", "spot"))
    return each.select("tree", "spot", "node")


def deeper(crowded: DataFrame, signs: DataFrame, level: int) -> DataFrame:
    """(tree, spot, node) of a level, from the crowded rows (tree, node) of the one before. A node has a row a tree at most."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"node": [], "tree": [], "spot": []}
        for node, sign, trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(sign, np.uint8)
            out["node"] += [node] * len(trees)
            out["tree"] += trees
            out["spot"] += [spot(own, t, level) for t in trees]
        return out

    asked = crowded.groupBy("node").agg(F.collect_list("tree").alias("trees")).join(signs.select("node", "sign"), "node").select("node", "sign", "trees")
    return arrow_map(asked, rows, "node long, tree int, spot long").select("tree", "spot", "node")


def central(crowded: DataFrame) -> DataFrame:
    """(spot, hub, n) of crowded regions, from their rows (spot, node, n): the hub is the member that stands in the most crowded ones, by the sum
    of their sizes over all trees and levels; of several the least."""
    weights = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    most = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("m")
    return crowded.join(weights, "node").groupBy("spot").agg(most, F.count("*").alias("n")).select("spot", (-F.col("m.minus")).alias("hub"), "n")


def regions(rows: DataFrame) -> DataFrame:
    """The rows (tree, spot, node) of regions with several members, written, with the region's size n."""
    return written(rows.join(rows.groupBy("spot").agg(F.count("*").alias("n")).where("n > 1"), "spot"))


def tried(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, and hub, the one of them that others are compared with, of regions' rows: all pairs of small regions, the
    members of crowded ones with the central one."""
    few, crowded, made = rows.where(F.col("n") <= REGION), rows.where(F.col("n") > REGION), []
    one, two = few.select("spot", F.col("node").alias("a")), few.select("spot", F.col("node").alias("b"))
    pairs = [one.join(two, "spot").where("a < b").select("a", "b", F.col("a").alias("hub"))]
    if total := crowded.count():
        made.append(written(central(crowded.select("spot", "node", "n"))))
        led = join_hot(crowded.select("spot", "node"), made[-1], ["spot"], total)
        pairs.append(led.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "hub"))
    out = written(united(pairs).groupBy("a", "b").agg(F.min("hub").alias("hub")))
    for x in made:
        forget(x)
    return out


def candidates(signs: DataFrame) -> DataFrame:
    """Pairs (a, b, hub) of nodes of signs (node, sign) that share a beginning of four bytes: all in small regions, in crowded ones those with
    the central member."""
    rows = regions(planted(signs))
    out = tried(rows)
    forget(rows)
    return out


def open_regions(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (tree, spot, node, group) of crowded regions whose members the links (a, b) do not connect yet."""
    rows = crowded.select("tree", "spot", "node").join(components(links), "node", "left").withColumn("group", F.coalesce("root", "node"))
    several = rows.groupBy("spot").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return written(rows.join(several, "spot", "left_semi").select("tree", "spot", "node", "group"))


def deeper_candidates(left: DataFrame, signs: DataFrame) -> list[DataFrame]:
    """Pairs (a, b, hub) by longer beginnings among those members of open regions that are not in their region's largest group."""
    groups = left.groupBy("spot", "group").agg(F.count("*").alias("k"))
    largest = groups.groupBy("spot").agg(F.max(F.struct("k", "group"))["group"].alias("most"))
    rows, pairs = left.join(largest, "spot").where("group <> most"), []
    for level in range(1, len(DEPTHS)):
        now = regions(deeper(rows.select("tree", "node"), signs, level))
        pairs.append(tried(now))
        rows = now.where(F.col("n") > REGION)
        if rows.isEmpty():
            break
    return pairs


def the_rest(left: DataFrame, signs: DataFrame, texts: DataFrame, words: int, near: tuple[int, int]) -> DataFrame:
    """Links (a, b) between unlike groups of open regions, from all pairs of their members, and not more of them than connect the groups.

    Regions with a member in common are worked on together, so that a pair that shares many regions is met once. Their members are dealt to
    blocks by hash, and a task compares two blocks: signatures first, then the sets of those that agree in AGREE bytes."""
    star = left.select("spot", "node").join(left.groupBy("spot").agg(F.min("node").alias("first")), "spot").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    members = left.select("node", "group").distinct().join(components(star), "node", "left").select("node", "group", F.coalesce("root", "node").alias("crowd")).join(signs.select("node", "sign"), "node")
    members = written(texts.select(F.col("row").alias("node"), "text").join(members, "node"))
    sizes = members.groupBy("crowd").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum(F.length("text")) / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    own = members.join(F.broadcast(sizes), "crowd").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "group", "sign", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for crowd, i, j, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (crowd, i, j):
                    yield from links_of(held, words, near)
                    now, held = (crowd, i, j), []
                held.append(member)
        yield from links_of(held, words, near)

    dealt = met.repartition(partitions(texts), "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j", "own", "node")
    out = written(small(dealt).mapInArrow(run, "a long, b long"))
    forget(members)
    return out


def links_of(members: list[list], words: int, near: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links between unlike groups of members (block, node, group, sign, text) in the order of their blocks, which are two or one."""
    if len(members) < 2 or len({m[2] for m in members}) < 2:
        return
    signs = np.frombuffer(b"".join(m[3] for m in members), np.uint8).reshape(-1, HASHES)
    ids, sets = np.unique(np.array([m[2] for m in members]), return_inverse=True)[1], []
    for m in members:
        sets.append(np.array([xxhash.xxh64_intdigest(x) for x in shingles(m[4], words)], np.uint64))
    size = np.array([len(x) for x in sets])
    every = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flat, start = every.astype(np.int32), np.concatenate([[0], np.cumsum(size)])
    second = next((k for k, m in enumerate(members) if m[0] != members[0][0]), 0)
    root, columns, a, b = list(range(int(ids.max()) + 1)), np.ascontiguousarray(signs.T), [], []
    in_a = np.zeros(int(flat.max(initial=0)) + 1, bool)

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(0, second or len(members), 256):
        these = slice(k, min(k + 256, second or len(members)))
        agree = np.zeros((these.stop - k, len(members) - second), np.uint8)
        for c in columns:
            agree += c[these, None] == c[None, second:]
        ok = (agree >= AGREE) & (ids[these, None] != ids[None, second:])
        n, m = size[these, None], size[None, second:]
        ok &= np.minimum(n, m) * near[1] >= np.maximum(n, m) * near[0]
        for r in np.flatnonzero(ok.any(axis=1)).tolist():
            x = k + r
            those = np.flatnonzero(ok[r]) + second
            those = those[those > x]
            if not len(those):
                continue
            in_a[flat[start[x] : start[x + 1]]] = True
            ends = np.cumsum(size[those])
            places = np.repeat(start[those] - (ends - size[those]), size[those]) + np.arange(ends[-1])
            both = np.add.reduceat(in_a[flat[places]], ends - size[those], dtype=np.int64)
            in_a[flat[start[x] : start[x + 1]]] = False
            for y in those[both * near[1] >= (size[x] + size[those] - both) * near[0]].tolist():
                one, two = top(int(ids[x])), top(int(ids[y]))
                if one != two and similar(shingles(members[x][4], words), shingles(members[y][4], words), near):
                    root[max(one, two)] = min(one, two)
                    a.append(min(members[x][1], members[y][1]))
                    b.append(max(members[x][1], members[y][1]))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def linked(signs: DataFrame, texts: DataFrame, words: int, near: tuple[int, int], more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all nodes of signs (node, sign) that are similar and share a beginning of four bytes in a tree, and those of
    the candidates more (a, b, hub), every one confirmed on the texts (row, text; see confirmed)."""

    def checked(pairs: list[DataFrame]) -> DataFrame:
        asked = written(agreeing(united(pairs).groupBy("a", "b").agg(F.min("hub").alias("hub")), signs))
        out = written(confirmed(asked, texts, words, near))
        for x in (*pairs, asked):
            forget(x)
        return out

    rows = regions(planted(signs))
    links = [checked([tried(rows), *([more] if more is not None else [])])]
    crowded = rows.where(F.col("n") > REGION)
    for step in range(0 if crowded.isEmpty() else 2):
        left = open_regions(crowded, united(links))
        if left.isEmpty():
            forget(left)
            break
        if step == 1:
            links.append(the_rest(left, signs, texts, words, near))
        elif pairs := deeper_candidates(left, signs):
            links.append(checked(pairs))
        forget(left)
    forget(rows)
    return united(links)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, near: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, from a, b and hub (one of the two) and texts (row, text), which are not moved if they
    lie in buckets by row. A hub's text is sent once for each SERVED of its pairs, the other texts once a pair."""
    other = pairs.select("hub", (F.col("a") + F.col("b") - F.col("hub")).alias("row"))
    per = written(other.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(SERVED)).cast("int").alias("copies")))
    total = per.agg(F.sum("n")).first()[0] or 0
    members = join_hot(other, per, ["hub"], total).select("hub", F.expr("cast(pmod(xxhash64(row), copies) as int)").alias("copy"), "row")
    hubs = per.select("hub", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"), F.col("hub").alias("row"))
    asked = members.withColumn("kind", F.lit(1)).unionByName(hubs.withColumn("kind", F.lit(0)))
    given = texts.select("row", "text").join(asked, "row").select("hub", "copy", "kind", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, set()
        for batch in batches:
            a, b = [], []
            for hub, copy, kind, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text, words)
                if kind == 0:
                    now, held = (hub, copy), own
                elif now != (hub, copy):
                    raise AssertionError(f"the text of {hub} is missing")
                elif similar(held, own, near):
                    a.append(min(hub, row))
                    b.append(max(hub, row))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    dealt = given.repartition(partitions(texts), "hub", "copy").sortWithinPartitions("hub", "copy", "kind")
    return small(dealt).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, near: tuple[int, int] = NEAR) -> DataFrame:
    """doc_id, n_shingles (the size of the set of shingles), component_id (the least doc_id that links reach, the row's own included) and kept
    (doc_id is component_id) of every row.

    Texts link at a similarity of near[0] / near[1] or more of their sets. A text of fewer words is one shingle; a text without words, or a
    null one, has none and is linked with nothing. Rows that repeat a doc_id count each by their own text. A row with a null doc_id has its
    component's least id, null if no other row has one, and is kept in that case only. Other columns are not read; an empty table gives none."""
    ready(docs.sparkSession)
    n = partitions(docs)
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = bucketed(source.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row"), n, "row")

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"row": batch.column(0), "doc_id": batch.column(1), "n_shingles": [], "words": [], "sign": []}
        for t in batch.column(2).to_pylist():
            own = shingles(t, words)
            out["n_shingles"].append(len(own))
            out["words"].append(xxhash.xxh3_128_digest(b"\n".join(sorted(own))))
            out["sign"].append(signature(np.array([xxhash.xxh64_intdigest(s, 42) for s in own], np.uint64)))
        return out

    prints = cut(arrow_map(rows.select("row", "doc_id", "text"), read, "row long, doc_id long, n_shingles long, words binary, sign binary"))
    nodes = written(prints.where("n_shingles > 0").groupBy("words").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("sign").alias("sign")))
    signs = nodes.select("node", "sign")
    rooted = nodes.join(components(linked(signs, rows, words, near)), "node", "left").select("words", "least", "n", F.coalesce("root", "node").alias("group"))
    rooted = written(rooted)
    ids = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "group").select("words", "n", "component_id"))
    total = named.agg(F.sum("n")).first()[0] or 0
    some = join_hot(prints.where("n_shingles > 0").select("doc_id", "n_shingles", "words"), named, ["words"], total).select("doc_id", "n_shingles", "component_id")
    none = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
