"""Task sets as one plan: many tasks over the rows of tables, tagged by their position and run as one job.

A task is a function of an element, over its own elements; all tasks of a set have one template and go through one Arrow map. An error is
data of its element, so a task fails by its least failing element and the others keep their values. What a task gives is either its
values in order, or a fold of them that the engine adds up before the shuffle. Nothing of a task's rows comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import element
from .errors import EngineError, RemoteError


def routed(table: DataFrame, task: Column, ix: Column, x: Column) -> DataFrame:
    """(pos, ix, x) of a table whose rows say which task they belong to, by its position from 1: one scan for all tasks."""
    return table.select(task.cast("long").alias("pos"), ix.cast("long").alias("ix"), x.alias("x"))


def tagged(frames: list[DataFrame]) -> DataFrame:
    """(pos, ix, x) of several element tables of one schema, each a task's own."""
    if not frames:
        raise EngineError("a task set has at least one task")
    out = None
    for k, t in enumerate(frames, 1):
        own = t.select(F.lit(k).cast("long").alias("pos"), "ix", "x")
        out = own if out is None else out.unionByName(own)
    return out


class TaskSet:
    """Tasks fs, by position from 1, over the elements (pos, ix, x) that name them; template as in element.map_python. ix is unique in a task.

    An element whose position no task has is an error of that position. All results are lazy, and each is one job over the elements."""

    def __init__(self, elements: DataFrame, fs: list[Callable], template: str, constants: tuple = ()):
        if not fs:
            raise EngineError("a task set has at least one task")
        self.elements, self.template, self.n = elements, template, len(fs)
        by_position = tuple(fs)

        def one(row, *more):
            k, x = row["pos"], row["x"]
            if k is None or not 0 < k <= len(by_position):
                raise LookupError(f"there is no task {k}")
            return by_position[k - 1](x, *more)

        # The map keeps a name beside ix: the position.
        named = elements.select(F.col("pos").cast("string").alias("name"), "ix", F.struct("pos", "x").alias("x"))
        done = element.map_python(named, one, template, constants)
        self.rows = done.select(F.col("name").cast("long").alias("pos"), "ix", "value", "error")

    def __repr__(self) -> str:
        return f"<{self.n} tasks in one plan>"

    def failures(self) -> DataFrame:
        """(pos, ix, error) of each task that failed: its first failing element."""
        first = F.min_by(F.struct("ix", "error"), "ix").alias("e")
        return self.rows.where("error is not null").groupBy("pos").agg(first).select("pos", "e.ix", "e.error")

    def values(self) -> DataFrame:
        """(pos, ix, value) of the tasks without a failure."""
        failed = self.rows.where("error is not null").select("pos").distinct()
        return self.rows.join(F.broadcast(failed), "pos", "left_anti").select("pos", "ix", "value")  # a row for each task at most

    def folds(self, fold: Callable[[Column], Column]) -> DataFrame:
        """(pos, n, value, ix, error): the fold (an aggregate) of each task's values; of a task that failed only its first error. One job and one
        shuffle of a row for each task and partition. A task without elements has no row."""
        bad = F.col("error").isNotNull()
        first = F.min_by(F.when(bad, F.struct("ix", "error")), F.when(bad, F.col("ix"))).alias("e")
        folded = self.rows.groupBy("pos").agg(F.count("*").alias("n"), fold(F.col("value")).alias("value"), first)
        return folded.select("pos", "n", F.when(F.col("e").isNull(), F.col("value")).alias("value"), "e.ix", "e.error")

    def first_failure(self) -> tuple[int, int, str] | None:
        """(position, element, error) of the first task by position that failed."""
        found = self.failures().orderBy("pos").limit(1).collect()
        return tuple(found[0]) if found else None

    def collect_all(self, fold: Callable[[Column], Column]) -> list:
        """The fold of each task in order, None for a task without elements; the first failure by position is raised with its index. A row a
        task comes to the driver."""
        out: list = [None] * self.n
        for pos, _, value, ix, error in self.folds(fold).orderBy("pos").toLocalIterator():
            if error is not None:
                raise RemoteError(error, index=pos, element=ix)
            out[pos - 1] = value
        return out
