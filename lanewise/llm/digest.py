"""Document fingerprints: a quartile digest of hashed byte triplets, compared by a bounded difference score."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, small, table

BUCKETS = 128
#: Largest difference: three for each bucket and the cap of the length's part.
LENGTH_CAP = 48
MOST = 3 * BUCKETS + LENGTH_CAP


def digest(text: bytes) -> bytes:
    """One byte for the length, then two bits for each bucket: the quartile in which its count of triplets lies."""
    a = np.frombuffer(text, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(a), 1 << 20):
        part = a[k : k + (1 << 20) + 2].astype(np.uint32)
        if len(part) > 2:
            code = (part[:-2] | part[1:-1] << 8 | part[2:] << 16) * np.uint32(0x9E3779B1)
            counts += np.bincount(code >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    size = min(255, int(round(8 * math.log2(len(text) + 1))))
    return bytes([size]) + (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8).tobytes()


_CODES = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.int16)
_APART = np.abs(_CODES[:, None, :] - _CODES[None, :, :]).sum(axis=2)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests down to 0: the difference of quartiles by bucket and of lengths, over its greatest value."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    apart = int(_APART[x[1:], y[1:]].sum()) + min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    return 1 - apart / MOST


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the first as many code points, or all, of another."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def neighbours(docs: DataFrame, per_shard: int = 2000) -> DataFrame:
    """Rows (shard, id, seq, text, guest) such that within a shard, ordered by id and seq downwards with guests last, each row's next
    document follows it. Ids, and the texts of an id with very many rows, are cut into ranges; the first document of the next range is sent to the range before it as a guest,
    so no row sees more than its own range and nothing is sorted in one place. Texts are dealt once."""
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, low, high = base.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n:
        return base.select(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("part")).alias("shard"), "id", F.lit(0).cast("long").alias("seq"), "text", F.lit(False).alias("guest")).where("false")
    want = max(1, min(20_000, n // per_shard))
    # Ids with more rows than two shards should hold are shards of their own, cut by the hash of the text: there are few of them.
    heavy = {r[0]: -(-r[1] * want // n) for r in base.groupBy("id").count().where(F.col("count") > 2 * n / want).collect()} if want > 1 else {}
    cuts = set(base.agg(F.percentile_approx("id", [k / want for k in range(1, want)], 100_000)).first()[0] or []) if want > 1 else set()
    cuts = sorted({x for x in cuts | {y for h in heavy if h is not None for y in (h, h + 1)} if x < 1 << 63})
    rows = base.withColumn("seq", F.xxhash64("text"))
    part = F.lit(0)
    if heavy:
        parts = F.broadcast(docs.sparkSession.createDataFrame(list(heavy.items()), "heavy long, parts int"))
        rows = rows.join(parts, F.col("id").eqNullSafe(F.col("heavy")), "left")
        part = F.coalesce(F.floor((F.col("seq") / 2.0**64 + 0.5) * F.col("parts")), F.lit(0))
    rows = rows.select("id", "seq", "text", F.struct(F.coalesce(_ranked(cuts), F.lit(-1)).cast("int").alias("rank"), part.cast("int").alias("part")).alias("shard"))
    first = {tuple(r[0]): (r[1]["id"], r[1]["seq"]) for r in rows.groupBy("shard").agg(F.max(F.struct("id", "seq")).alias("top")).collect()}
    order = sorted(first, reverse=True)
    guest_of = {first[order[(k + 1) % len(order)]]: s for k, s in enumerate(order)}
    spark = docs.sparkSession
    guests = spark.createDataFrame([(i, q, s) for (i, q), s in guest_of.items()], "id long, seq long, to struct<rank:int,part:int>")
    sent = rows.join(F.broadcast(guests), (rows["id"].eqNullSafe(guests["id"])) & (rows["seq"] == guests["seq"])).select(F.col("to").alias("shard"), rows["id"], rows["seq"], "text", F.lit(True).alias("guest"))
    return rows.select("shard", "id", "seq", "text", F.lit(False).alias("guest")).union(sent)


def _ranked(cuts: list[int]):
    """How many cuts are at most the id, by halving: the expression's depth is the logarithm of their number."""

    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") >= cuts[mid], half(mid + 1, hi)).otherwise(half(lo, mid))

    return F.when(F.col("id").isNotNull(), half(0, len(cuts)))


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text's digest columns and the digests of each row's whole text, its edited text and the next document.

    The next document is the one of the next smaller doc_id, after the smallest the one of the largest; a single document follows
    itself. Null texts are empty. Null ids come last. Rows that repeat an id are ordered by the hash of their texts, downwards; equal rows
    are interchangeable. Other columns are not read."""
    placed = neighbours(docs).repartition("shard").sortWithinPartitions("shard", "guest", F.desc_nulls_last("id"), F.desc("seq"))

    def run(batches):
        held = None
        out = []

        def close(row, following):
            _, i, text, fp = row
            ed = edited(text, following[2])
            raw = ed.encode()
            efp = digest(raw)
            return (i, len(text), hashlib.sha256(raw).hexdigest(), fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, following[3]))

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

        lost = None
        for batch in batches:
            for shard, i, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = (shard["rank"], shard["part"])
                if guest and lost == shard:  # one guest is enough: rows equal to it came along
                    continue
                now = (shard, i, text, digest(text.encode()))
                if held is not None and held[0] == shard:
                    out.append(close(held, now))
                lost, held = (shard, None) if guest else (None, now)
            if out:
                yield flush()

    return small(placed.select("shard", "id", "text", "guest")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
