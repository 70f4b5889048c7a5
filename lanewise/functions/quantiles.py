"""Exact quantiles by narrowing: histograms over the ranges that hold the wanted ranks, until a range has few values, which are selected.

Each pass counts at most BINS bins for each wanted rank and keeps their bounds, so memory is the same for any number of rows. A range's own
least and greatest value bound the next one: at least two bins of every pass are occupied, and a bin of one value is done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.operators.errors import EngineError

#: Bins of a range in one pass, and values of a range that are selected from at once.
BINS, FEW = 2048, 4096


def quantiles(df: DataFrame, x: Column, probs: list[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The quantiles of x as doubles, with linear interpolation between neighbours, exactly as a sort would give them. Missing values don't
    count, without any other there are none. Not-a-number is above all numbers, infinities are at the ends."""
    if any(not 0 <= p <= 1 for p in probs):
        raise EngineError("a quantile's probability is from 0 to 1")
    v = df.select(x.cast("double").alias("x")).where("x is not null")
    finite = F.abs("x") < F.lit(math.inf)
    n, low, high, nan, least, most = v.agg(F.count("*"), F.count_if(F.col("x") == F.lit(-math.inf)), F.count_if(F.col("x") == F.lit(math.inf)), F.count_if(F.isnan("x")), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    if not n:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    known = {k: -math.inf if k < low else math.nan if k >= n - nan else math.inf for k in ranks if k < low or k >= n - nan - high}
    if wanted := [k for k in ranks if k not in known]:
        known |= selected(v.where(finite), wanted, least, most, low, n - low - high - nan, bins, few)
    out = []
    for p in places:
        a, b = known[math.floor(p)], known[math.ceil(p)]
        out.append(a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out


def selected(v: DataFrame, wanted: list[int], least: float, most: float, below: int, n: int, bins: int, few: int) -> dict[int, float]:
    """The values of these ranks; below values lie under least, n from least to most."""
    known: dict[int, float] = {}
    ranges = [(least, most, below, n, wanted)]
    while ranges:
        open_ = []
        for lo, hi, under, count, own in ranges:
            if lo == hi:
                known |= dict.fromkeys(own, lo)
            else:
                open_.append((lo, hi, under, count, own))
        small = [r for r in open_ if r[3] <= few]
        if small:
            here = None
            for lo, hi, *_ in small:
                inside = F.col("x").between(lo, hi)
                here = inside if here is None else here | inside
            values = sorted(r[0] for r in v.where(here).collect())  # few for each wanted rank
            for lo, hi, under, _, own in small:
                within = [y for y in values if lo <= y <= hi]
                known |= {k: within[k - under] for k in own}
        large = [r for r in open_ if r[3] > few]
        if not large:
            return known
        which, at = F.lit(None).cast("int"), F.lit(None).cast("int")
        for j, (lo, hi, *_) in enumerate(large):
            inside = F.col("x").between(lo, hi)
            # Halves, as the whole range may exceed the largest number.
            share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            which = F.when(inside, F.lit(j)).otherwise(which)
            at = F.when(inside, F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))).otherwise(at)
        counts = v.select("x", which.alias("j"), at.alias("bin")).where("j is not null").groupBy("j", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found: dict[int, list] = {}
        for r in counts.collect():
            found.setdefault(r["j"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        ranges = []
        for j, (_, _, under, _, own) in enumerate(large):
            for _, count, lo, hi in sorted(found[j]):
                if inner := [k for k in own if under <= k < under + count]:
                    ranges.append((lo, hi, under, count, inner))
                under += count
    return known
