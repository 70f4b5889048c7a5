"""Shingle sets and their min-hash signatures: 128 min-hashes of a set, a byte of each."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .simhash import LOWER

#: Min-hashes of a signature, and bytes in which those of similar sets agree at least: of sets at 0.8 about 102 do, give or take 4.5.
HASHES, AGREE = 128, 77
_G = np.random.default_rng(5)
_TIMES = _G.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _G.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int) -> set[bytes]:
    """The distinct shingles; a text of fewer words is one shingle, a text without words has none."""
    parts = (text or b"").translate(LOWER).split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return {joined} if parts else set()
    ends = list(itertools.accumulate(map((1).__add__, map(len, parts))))
    return {joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)}


def similar(a: set[bytes], b: set[bytes], near: tuple[int, int]) -> bool:
    both = len(a & b)
    return both * near[1] >= (len(a) + len(b) - both) * near[0]


def signature(h: np.ndarray) -> bytes | None:
    """A byte of each min-hash of the shingles' hashes; none for a text without words, which has no near copies but its exact ones."""
    if not len(h):
        return None
    h = np.unique(h)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 512):
        np.minimum(least, (h[k : k + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least * _MIX >> np.uint64(56)).astype(np.uint8).tobytes()


def agreeing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b, and longs besides) whose signatures agree in enough bytes."""
    names = ["a", "b", *[c for c in pairs.columns if c not in ("a", "b")]]
    a, b = signs.select(F.col("node").alias("a"), F.col("sign").alias("s")), signs.select(F.col("node").alias("b"), F.col("sign").alias("t"))

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (-2, -1))
        ok = pa.array((s == t).sum(axis=1) >= AGREE)
        return {n: batch.column(k).filter(ok) for k, n in enumerate(names)}

    return arrow_map(pairs.join(b, "b").join(a, "a").select(*names, "s", "t"), rows, ", ".join(f"{n} long" for n in names))
