"""Near copies as the pipeline drops them: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Texts of equal words are merged first. Candidates come from the trie self-join of the texts' five-word SimHash fingerprints, which
finds close copies; at 0.8 two fingerprints differ in about ten bits, and a walk with that budget would visit nearly all pairs of
nodes. So the rest come from the LSH forest over the texts' min-hash signatures (see forest): no region's members are left uncompared
because there are many of them, crowded regions compare with their central text and what that leaves apart in full. Every link is
verified on the shingles; the text that many are compared with is dealt once for a bounded number of them.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.session import bucketed

from .common import arrow_map, cut, partitions, place_of
from .forest import linked
from .signatures import HASHES, signature
from .simhash import LOWER, components, links, majority, shingle_hashes, signed

__all__ = ["HASHES", "NEAR", "WORDS", "drop_near_copies", "groups", "shingle_hashes", "signature"]

#: Words of a shingle; the similarity is at least NEAR[0] / NEAR[1].
WORDS, NEAR = 5, (4, 5)


def trie_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, of nodes with equal fingerprints (each with the first one) or linked ones, from node and fp."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (first.select(F.col("fp").alias(k), F.col("first").alias(f"node_{k}")) for k in "ab")
    linked = links(first.select("fp")).join(one, "a").join(two, "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return cut(equal.union(linked))


def groups(rows: DataFrame) -> DataFrame:
    """row, doc_id, text_hash and group of every row of rows (row, a unique number, doc_id, text): equal groups are near copies."""

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"row": batch.column(0), "doc_id": batch.column(1), "text_hash": [], "words": [], "fp": [], "sign": []}
        for t in batch.column(2).to_pylist():
            parts = (t or b"").translate(LOWER).split()
            h = shingle_hashes(parts, WORDS)
            out["text_hash"].append(xxhash.xxh3_128_digest(t or b""))
            out["words"].append(xxhash.xxh3_128_digest(b" ".join(parts)))
            out["fp"].append(signed(majority(h)))
            out["sign"].append(signature(h))
        return out

    source = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = cut(arrow_map(source, read, "row long, doc_id long, text_hash binary, words binary, fp long, sign binary"))
    nodes = cut(prints.groupBy("words").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("sign").alias("sign")))
    signs = nodes.where("sign is not null").select("node", "fp", "sign")
    near = trie_candidates(signs).select("a", "b", F.col("a").alias("hub"))
    edges = linked(signs, source, WORDS, NEAR, near)
    by_words = nodes.join(components(edges), "node", "left").select("words", F.coalesce("root", "node").alias("group"))
    return prints.join(by_words, "words").select("row", "doc_id", "text_hash", "group")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one of each group of near copies: that of the least doc_id, ids before nulls, then of the least
    hash of its text. Rows count by themselves, so rows without an id or with a shared one are kept like any other.

    The rows are dealt once, into buckets by their number: texts that are compared and rows that go are then found without moving all."""
    names, n = docs.columns, partitions(docs)
    plain = [f"c{k}" for k in range(len(names))]
    rows = bucketed(docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()).repartition(n, "row"), n, "row")
    doc_id, text = (plain[place_of(docs, c)] for c in ("doc_id", "text"))
    found = cut(groups(rows.select("row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    kept = found.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col("first.row").alias("kept"))
    gone = found.join(kept, "group").where("row <> kept").select("row")
    return rows.join(gone, "row", "left_anti").select(*plain).toDF(*names)
