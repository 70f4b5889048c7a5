"""Matrices of maps with several values an element, in blocks: an element is a column, its values are the rows.

A matrix stays a frame. It is cut into tiles of at most BLOCK columns of one row, so that turning it over needs no row of the whole width,
and its entries have their place column by column, so that it can be exported in that order by ranges. Names of rows and columns go along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import TemplateMismatch

#: Columns of a tile.
BLOCK = 1024


@dataclass(frozen=True)
class Matrix:
    """entries: row, col (both from 1), value. row_names and col_names: (row, name) and (col, name), or None. m rows."""

    entries: DataFrame
    m: int
    row_names: DataFrame | None = None
    col_names: DataFrame | None = None

    def tiles(self, block: int = BLOCK) -> DataFrame:
        """row, block (from 0), first (its first column) and values, by column: of each row one tile for each block of columns. A missing value
        has its place; one shuffle, and no more than a block's values in a row."""
        at = F.floor((F.col("col") - 1) / block)
        held = self.entries.groupBy("row", at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("v"))
        return held.select("row", "block", F.col("v")[0]["col"].alias("first"), F.transform("v", lambda x: x["value"]).alias("values"))

    def transposed(self) -> Matrix:
        """The matrix turned over; m is then the number of columns, which one count finds."""
        turned = self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
        names = [None if x is None else x.withColumnRenamed(a, b) for x, a, b in ((self.col_names, "col", "row"), (self.row_names, "row", "col"))]
        return Matrix(turned, self.entries.agg(F.max("col")).first()[0] or 0, *names)

    def column_major(self) -> DataFrame:
        """pos (from 1) and value: all entries column after column, as a flat vector has them, without a shuffle; sort by pos to write them out."""
        return self.entries.select(((F.col("col") - 1) * self.m + F.col("row")).alias("pos"), "value")

    def named(self) -> DataFrame:
        """row, col, row_name, col_name, value; names are missing where there are none."""
        out = self.entries
        for names, key in ((self.row_names, "row"), (self.col_names, "col")):
            out = out.join(names.withColumnRenamed("name", f"{key}_name"), key, "left") if names is not None else out.withColumn(f"{key}_name", F.lit(None).cast("string"))
        return out.select("row", "col", "row_name", "col_name", "value")


def of_map(mapped: DataFrame, m: int, row_names: list[str] | None = None) -> Matrix:
    """The matrix of a map (ix, name, value) whose values are arrays of m: element ix is column ix, and its name the column's. An element of
    another length, or one that failed, is an error when it is read."""
    if row_names is not None and len(row_names) != m:
        raise TemplateMismatch(f"{len(row_names)} names don't fit a template of length {m}")
    gate = F.when(F.size("value") == m, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("template length mismatch at element "), F.col("ix").cast("string"))))
    entries = mapped.select(F.col("ix").alias("col"), F.posexplode(gate).alias("_row", "value")).select((F.col("_row") + 1).cast("long").alias("row"), "col", "value")
    spark = mapped.sparkSession
    rows = spark.createDataFrame(list(enumerate(row_names, 1)), "row long, name string") if row_names else None
    cols = mapped.select(F.col("ix").alias("col"), "name") if "name" in mapped.columns else None
    return Matrix(entries, m, rows, cols)


def product(a: Matrix, x: Column, by: DataFrame) -> DataFrame:
    """row and value of the matrix times a vector, by: (col, and the column x of it): partial sums before the one shuffle by row."""
    return a.entries.join(by.select("col", x.alias("_x")), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))
