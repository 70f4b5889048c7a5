"""Nested maps as one flat plan.

A nested map splits each element into parts, maps them (by another nested map if need be) and folds the results. Executors start no jobs,
so nothing is nested while it runs: each level is one explode that numbers its parts, the innermost function is a projection, and the
folds go back up one level after the other. Folds of one kind that only add up (sum, min, max) are done at once.

The elements are dealt before they are split, at most about DEALT to a task however many there are; all parts of an element then lie in one
task, which folds every level without another shuffle and holds the folds of its own elements only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import EngineError

#: Folds of folds that equal one fold of all.
ASSOCIATIVE = {"sum": F.sum, "min": F.min, "max": F.max}
#: Elements that one task splits and folds.
DEALT = 1 << 12


@dataclass(frozen=True)
class Nested:
    """split: an element to an array of parts; inner: a column function, or another Nested, of a part; fold: sum, min, max, or a function from a
    column to an aggregate; none: what an element without parts gives."""

    split: Callable[[Column], Column]
    inner: Callable[[Column], Column] | Nested
    fold: str | Callable[[Column], Column] = "sum"
    none: object = None

    def levels(self) -> list[Nested]:
        return [self, *(self.inner.levels() if isinstance(self.inner, Nested) else [])]

    def fold_of(self, x: Column) -> Column:
        out = ASSOCIATIVE[self.fold](x) if isinstance(self.fold, str) else self.fold(x)
        return out if self.none is None else F.coalesce(out, F.lit(self.none))


def flat(table: DataFrame, nest: Nested) -> DataFrame:
    """(ix, part_1, ..., part_n, x): the innermost parts of a table's elements (ix, x), mapped. A part's number counts from 1; an element, or a
    part, without parts of its own has one row with a null number and value."""
    levels = nest.levels()
    out, names = table.select("ix", "x"), ["ix"]
    for k, level in enumerate(levels, 1):
        out = out.select(*names, F.posexplode_outer(level.split(F.col("x"))).alias("_at", "x")).withColumn(f"part_{k}", F.col("_at") + 1).select(*names, f"part_{k}", "x")
        names.append(f"part_{k}")
    return out.withColumn("x", levels[-1].inner(F.col("x")))


def nested_map(table: DataFrame, nest: Nested) -> DataFrame:
    """(ix, value) of a nested map over the elements (ix, x) of a table, to any depth: the elements are counted, scanned and shuffled once. They
    are folded at once if all levels fold alike by sum, min or max and none names a value for no parts, else level by level."""
    table = table.select("ix", "x")
    levels, out = nest.levels(), flat(table.repartition(-(-table.count() // DEALT) or 1, "ix"), nest)
    alike = {level.fold if isinstance(level.fold, str) else None for level in levels}
    if len(alike) == 1 and None not in alike and all(level.none is None for level in levels[1:]):
        return out.groupBy("ix").agg(levels[0].fold_of(F.col("x")).alias("value"))
    for k in range(len(levels) - 1, -1, -1):
        out = out.groupBy("ix", *[f"part_{j}" for j in range(1, k + 1)]).agg(levels[k].fold_of(F.col("x")).alias("x"))
    return out.withColumnRenamed("x", "value")


def fold_segments(table: DataFrame, segments: list[str], value: Column, folds: list[Callable[[Column], Column]], name: str = "value") -> DataFrame:
    """A table whose rows already say which segments hold them (outermost first), folded segment by segment from the innermost: folds[k] goes
    over the parts of segments[:k], folds[0] gives one row for all. One scan; every later fold reads what the one before it left."""
    if len(folds) != len(segments) + 1:
        raise EngineError("there is one fold for each level of segments, and one for all")
    out = table.select(*segments, value.alias(name))
    for k in range(len(segments), -1, -1):
        parts = F.count("*").alias("parts")
        out = out.groupBy(*segments[:k]).agg(folds[k](F.col(name)).alias(name), parts)
    return out
