"""Which elements were issued and never completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lost_ranges(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, lo, hi), inclusive from 1. spans: run, start, count in morsels; runs: run, cursor, size, n. The gaps below
    min(cursor * size, n) that no completed span covers; what was never issued is not lost."""
    end = F.least(F.col("cursor") * F.col("size"), F.col("n"))
    done = spans.join(runs, "run").select("run", (F.col("start") * F.col("size")).alias("a"), F.least((F.col("start") + F.col("count")) * F.col("size"), F.col("n")).alias("b"))
    marks = done.unionByName(runs.select("run", end.alias("a"), end.alias("b")))
    w = Window.partitionBy("run").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.withColumn("to", F.coalesce(F.max("b").over(w), F.lit(0)))
    return gaps.where("a > to").select("run", (F.col("to") + 1).cast("long").alias("lo"), F.col("a").cast("long").alias("hi")).distinct()


def lost_chunks(chunks: DataFrame, finished: DataFrame) -> DataFrame:
    """(run, lo, hi) of the chunks (run, k, lo, hi) that no row of finished (run, k) names: the exact range of each chunk that died."""
    return chunks.join(finished.select("run", "k").distinct(), ["run", "k"], "left_anti").select("run", "lo", "hi")


def label(ranges: Column) -> Column:
    """"lo-hi" of each range, by lo, joined by a comma and a blank; (none) without any."""
    text = F.array_join(F.transform(F.array_sort(ranges), lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), ", ")
    return F.when(F.size(ranges) > 0, text).otherwise(F.lit("(none)"))
