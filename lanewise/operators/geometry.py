"""How n elements are dealt: closed forms, as Python numbers and as Spark columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MORSELS_PER_RUNNER, MORSEL_MOST, CHUNKS_PER_WORKER, STREAM_CHUNKS = 256, 256, 8, 32


def balanced_ranges(n: int, chunks: int) -> list[tuple[int, int]]:
    """(lo, hi) of each chunk, from 1, inclusive: the first n mod chunks hold one element more."""
    q, r = divmod(n, chunks)
    return [((k - 1) * q + min(k - 1, r) + 1, k * q + min(k, r)) for k in range(1, chunks + 1)]


def balanced_frame(spark: SparkSession, n: int, chunks: int) -> DataFrame:
    q, r = divmod(n, chunks)
    k = F.col("k")
    return spark.range(1, chunks + 1).select(F.col("id").alias("k")).select("k", ((k - 1) * q + F.least(k - 1, F.lit(r)) + 1).alias("lo"), (k * q + F.least(k, F.lit(r))).alias("hi"))


def chunk_of(ix, n: int, chunks: int):
    """The chunk that holds element ix, without a join."""
    q, r = divmod(n, chunks)
    head = r * (q + 1)
    return F.when(ix <= head, F.floor((ix - 1) / (q + 1)) + 1).otherwise(F.floor((ix - 1 - head) / max(1, q)) + r + 1).cast("long")


def chunk_count(n: int, workers: int, free: int = 1 << 30, cap: int = 1 << 30, n_chunks: int | None = None) -> int:
    return max(1, min(n, n_chunks or CHUNKS_PER_WORKER * workers, free, cap))


def morsel_size(n: int, runners: int, n_chunks: float | None = None) -> int:
    if n_chunks is not None:
        return -(-n // min(n, int(n_chunks)))
    return max(1, min(n // (runners * MORSELS_PER_RUNNER), MORSEL_MOST))


def morsel_count(n: int, size: int) -> int:
    return -(-n // size)


def morsel_frame(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(morsel, lo, hi) of each morsel from 0, elements from 1, inclusive."""
    m = F.col("morsel")
    return spark.range(morsel_count(n, size)).select(F.col("id").alias("morsel")).select("morsel", (m * size + 1).alias("lo"), F.least((m + 1) * size, F.lit(n)).cast("long").alias("hi"))


def morsel_span(first: int, k: int, size: int, n: int) -> tuple[int, int]:
    return first * size + 1, min((first + k) * size, n)


def runner_count(morsels: int, live: int, free: int = 1 << 30, cap: int = 1 << 30) -> int:
    return min(morsels, max(1, live), free, cap)


def stream_window(n: int, workers: int, free: int = 1 << 30, n_chunks: int | None = None) -> tuple[int, int]:
    """(chunks, chunks in flight) of a streamed map."""
    c = max(1, min(n, n_chunks or STREAM_CHUNKS * workers))
    return c, max(1, min(c, 2 * workers, free))
