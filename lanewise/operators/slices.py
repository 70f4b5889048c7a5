"""Streamed maps: fixed slices of a table under a sliding window of jobs, each written where the cluster can read it, and a ledger of
what has been written, from which a broken run goes on."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanewise.session import ship

from . import geometry
from .errors import EngineError, RemoteError, WorkerDied


def first_attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, in a task's first attempt only."""
    if (n := TaskContext.get().attemptNumber()) > 0:
        raise WorkerDied(f"attempt {n} of a slice that is not tried again")
    yield from batches


class Ledger:
    """What a run has committed, below a folder that the cluster shares: an entry for each slice, written after the slice itself. A slice's
    folder that no entry names (of a run that broke off, or of an earlier run) is never read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        sc = spark.sparkContext
        self.path = lambda *x: sc._jvm.org.apache.hadoop.fs.Path("/".join([folder, "_ledger", *x]))
        self.fs = self.path().getFileSystem(sc._jsc.hadoopConfiguration())

    def put(self, name: str, entry: dict) -> None:
        """An entry appears whole or not at all."""
        draft = self.path(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        self.fs.delete(self.path(name), False)
        if not self.fs.rename(draft, self.path(name)):
            raise EngineError(f"the ledger below {self.folder} takes no entry {name}")

    def entries(self) -> dict[str, dict]:
        """All entries by name; the driver holds one for each slice."""
        if not self.fs.exists(self.path()):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path())]
        names = sorted(n for n in names if not n.startswith("."))
        return {n: json.loads(self._read(n)) for n in names}

    def _read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def begin(self, shape: dict, resume: bool) -> tuple[str, dict[int, dict]]:
        """(run, its committed slices): those of the run of this shape that broke off, or a new run without any. A new run's entries take the
        place of all others."""
        old = self.entries()
        run = old.get("run")
        if resume and run and run["shape"] == shape:
            return run["id"], {int(n): e for n, e in old.items() if n != "run" and e["run"] == run["id"]}
        new = uuid.uuid4().hex
        self.put("run", {"id": new, "shape": shape})
        for n in old:
            if n != "run":
                self.fs.delete(self.path(n), False)
        return new, {}


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(run, k, lo, hi) of the slices that the run below a folder has committed: what lost.lost_chunks calls finished."""
    entries = Ledger(spark, folder).entries()
    own = entries.get("run", {}).get("id")
    rows = [(e["run"], int(n), e["lo"], e["hi"]) for n, e in entries.items() if n != "run" and e["run"] == own]
    return spark.createDataFrame(rows, "run string, k long, lo long, hi long")


def missing(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """The ranges, in order, that the run below a folder has not committed."""
    entries = Ledger(spark, folder).entries()
    if (run := entries.get("run")) is None:
        return []
    spans = geometry.balanced_ranges(run["shape"]["n"], run["shape"]["chunks"])
    return [span for k, span in enumerate(spans) if entries.get(str(k), {}).get("run") != run["id"]]


def map_in_slices(table: DataFrame, n: int, f: Callable[[DataFrame], DataFrame], out: str, workers: int, n_chunks: int | None = None, retry: bool = True, resume: bool = False, fail_fast: bool = False) -> DataFrame:
    """The rows of f over slices of a table with a dense ix from 1 to n, with at most the window's jobs at a time.

    A slice filters ix, which reaches the scan, writes a folder of its own below out, a path that all executors share, and is then entered
    in the ledger there; only slices that the ledger names are read. The result is the same as f over the whole table when f maps rows.
    Once a slice is lost those that have not begun are not tried; the ranges of all lost ones are raised in order, with the error of the
    first. Without retry a slice whose worker was lost is not computed a second time. With resume a run of the same n and number of slices
    that broke off goes on with the slices that it lacks. With fail_fast the rows of f hold ix and error (as element.map_python gives
    them), and an element's error ends the map: slices begin in order, those above the failing one are interrupted and those below it are
    finished, so the error raised is that of the least failing element of all, its index with it, and what lies above is not read."""
    spark = table.sparkSession
    ship(spark)
    if n <= 0:
        return f(table.limit(0))
    chunks, window = geometry.stream_window(n, workers, n_chunks=n_chunks)
    spans = geometry.balanced_ranges(n, chunks)
    ledger = Ledger(spark, out)
    run, have = ledger.begin({"n": n, "chunks": chunks}, resume)
    tag = f"lanewise-slices-{run}"

    def one(k: int) -> tuple[int, str] | None:
        lo, hi = spans[k]
        own = table.where(F.col("ix").between(lo, hi))
        made = f(own if retry else own.mapInArrow(first_attempt, own.schema))
        seen = Observation(f"{tag}-{k}") if fail_fast else None
        if seen:
            made = made.observe(seen, F.min(F.when(F.col("error").isNotNull(), F.struct("ix", "error"))).alias("first"))
        spark.sparkContext.addJobTag(f"{tag}-{k}")
        try:
            made.write.mode("overwrite").parquet(f"{out}/run={run}/slice={k}")
        finally:
            spark.sparkContext.removeJobTag(f"{tag}-{k}")
        if seen and (first := seen.get["first"]) is not None:
            return first["ix"], first["error"]
        ledger.put(str(k), {"run": run, "lo": lo, "hi": hi})
        return None

    todo = iter([k for k in range(chunks) if k not in have])
    running: dict = {}
    errors: dict[int, BaseException] = {}
    found: dict[int, tuple[int, str]] = {}
    with ThreadPoolExecutor(window) as jobs:
        while True:
            limit = min([*errors, *found], default=chunks)
            while len(running) < window and not errors and not found and (k := next(todo, None)) is not None:
                running[jobs.submit(one, k)] = k
            for k in running.values():
                if found and k > limit:
                    spark.sparkContext.cancelJobsWithTag(f"{tag}-{k}")
            if not running:
                break
            for x in wait(running, timeout=0.2 if found else None, return_when=FIRST_COMPLETED).done:
                k = running.pop(x)
                if error := x.exception():
                    if not found or k < min(found):  # what lies above the failing element was interrupted
                        errors[k] = error
                elif x.result() is not None:
                    found[k] = x.result()
    if found and not any(k < min(found) for k in errors):
        k = min(found)
        raise RemoteError(found[k][1], index=found[k][0], slice=k)
    if errors:
        lost = [spans[k] for k in sorted(errors)]
        first = errors[min(errors)]
        raise WorkerDied(f"slices {', '.join(f'{lo}-{hi}' for lo, hi in lost)} were lost: {first}", lost=lost) from first
    return spark.read.parquet(*[f"{out}/run={run}/slice={k}" for k in range(chunks)])


def batch_frame(table: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, first, last, n) of a table dealt into batches of so many keys, without a sort."""
    return table.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
