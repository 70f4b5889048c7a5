"""Helpers that the text operators share: tables, Arrow maps, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import cut, forget, ship, with_batches, written

__all__ = ["BATCH_ROWS", "arrow_map", "carry", "cut", "forget", "fresh", "held", "held_out", "join_hot", "partitions", "pick", "place_of", "ready", "ship", "small", "table", "written"]

#: Rows of one Arrow batch. Long texts make large rows, so batches hold few of them.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> None:
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """The frame with small Arrow batches and this library on the executors."""
    ship(df.sparkSession)
    return with_batches(df, BATCH_ROWS)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, found by place: an extra column that differs from one of them in case alone does not clash."""
    at = [place_of(df, n) for n in names]
    if None in at:
        raise ValueError(f"the frame has no column {names[at.index(None)]!r}")
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[F.col(f"c{k}").alias(n) for k, n in zip(at, names, strict=True)])


def place_of(df: DataFrame, name: str) -> int | None:
    """Where a column stands, found as pick finds it; none if there is no such column."""
    lower = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else lower.index(name.lower()) if name.lower() in lower else None


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key of more than this part of all rows is joined by broadcast: there are at most as many of them.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """The inner join of left, of total rows, with right, which has one row for each key and in n how many rows of left have it. Keys
    with a large part of all rows, at most HOT of them, are broadcast, so that their rows are not dealt to one task."""
    hot, cold = right.where(F.col(n) * HOT >= total), right.where(F.col(n) * HOT < total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


#: Bytes of files that a partition stands for at most.
MOST = 128 << 20


def partitions(df: DataFrame, each: int = 4 << 20) -> int:
    """Partitions for a shuffle of the frame as the session has them set, fewer for a small input. A frame that is read from files alone gets
    more where each would stand for over MOST bytes of them; of other frames the planner's estimates may be far too large."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    files = [leaves.apply(k) for k in range(leaves.size())]
    if not all(x.nodeName().startswith("LogicalRelation") for x in files):
        return n
    return max(1, min(n, -(-int(plan.stats().sizeInBytes()) // each)), -(-sum(int(x.stats().sizeInBytes()) for x in files) // MOST))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose crc32 of the id's text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(False))


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to the columns of its result."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = [_KINDS[x.strip().split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return small(df).mapInArrow(run, schema)


_held: list = [None, None]


def held(key: object, make: Callable[[], object]) -> object:
    """What this worker process keeps for one operator and its broadcast, or its name: made once, and dropped when another takes the place."""
    if _held[0] is not key and not (isinstance(key, str) and _held[0] == key):
        _held[:] = None, None
        _held[:] = key, make()
    return _held[1]


def carry(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over all columns, which keep their places, types and names, even names that differ in case alone."""
    flat = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return small(flat).mapInArrow(run, flat.schema).toDF(*df.columns)


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}
