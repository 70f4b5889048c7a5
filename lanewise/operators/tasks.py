"""Task sets: futures over Spark jobs on one session, collected once, in order, or as they end."""

from __future__ import annotations

import asyncio
import contextvars
import itertools
import threading
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from concurrent.futures import CancelledError as LostFuture
from concurrent.futures import TimeoutError as Late
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .element import call
from .errors import TIMEOUT, Cancelled, EngineError, SlotsExhausted, Stopped, WorkerDied


#: States of a task, by their number.
STATES = ("free", "pending", "running", "ok", "err", "cancel", "died", "lost")
#: The state after each event.
_AFTER = {"submit": "pending", "start": "running", "done": "ok", "error": "err", "died": "died", "lost": "lost"}


class Task:
    def __init__(self, future: Future):
        self.future, self.spent, self.dropped = future, False, False
        self.id, self.pool, self.run = 0, None, None

    def __repr__(self) -> str:
        return f"<task {self.id}: {'spent' if self.spent else 'cancelled' if self.dropped else 'done' if self.future.done() else 'running' if self.future.running() else 'pending'}>"


class Pool:
    """capacity bounds the tasks that have not ended; None sets no bound."""

    def __init__(self, spark: SparkSession, workers: int = 4, capacity: int | None = None):
        if workers < 1 or (capacity is not None and capacity < 1):
            raise EngineError("a pool has at least one worker and room for one task")
        self.spark, self.workers, self.capacity, self.executor, self.stopped = spark, workers, capacity, ThreadPoolExecutor(workers), False
        self.ids, self.events, self.watcher, self.open, self.lock = itertools.count(1), [], None, {}, threading.Lock()

    def __repr__(self) -> str:
        return f"<pool of {self.workers} workers, {len(self.open)} open tasks{', stopped' if self.stopped else ''}>"

    def note(self, event: str, task: int) -> None:
        """Keep what happened to a task and in which thread: submit, start, done, error, died, lost or drop. A watcher that fails changes nothing."""
        with self.lock:
            self.events.append((len(self.events) + 1, task, event, time.time(), threading.current_thread().name))
        if self.watcher:
            try:
                self.watcher(event, task)
            except Exception:  # noqa: BLE001
                self.watcher = None

    def submit(self, f: Callable, /, **args) -> Task:
        with self.lock:  # room is taken where it is found
            if self.stopped:
                raise Stopped("the pool has stopped")
            if self.capacity is not None and len(self.open) >= self.capacity:
                raise SlotsExhausted("the pool has no room for another task", capacity=self.capacity)
            n = next(self.ids)
            tag = self.open[n] = f"lanewise-task-{id(self)}-{n}"

        def run():
            self.note("start", n)
            token = _current.set(self)
            self.spark.sparkContext.addJobTag(tag)
            try:
                value = f(**args)
            except WorkerDied:
                self.note("died", n)
                raise
            except BaseException:
                self.note("error", n)
                raise
            finally:
                self.spark.sparkContext.removeJobTag(tag)
                _current.reset(token)
                self.open.pop(n, None)
            self.note("done", n)
            return value

        self.note("submit", n)
        try:
            task = Task(self.executor.submit(run))
        except RuntimeError:  # stopped meanwhile
            self.open.pop(n, None)
            raise Stopped("the pool has stopped") from None
        task.id, task.pool, task.run, task.tag = n, self, run, tag
        return task

    def submit_batch(self, fs: list[Callable], /, **args) -> list[Task]:
        """A task for each function, with the same arguments; fewer if the pool has no room for all. With no room for any it raises, and
        so it does when it has stopped, with the accepted ones as tasks that can be collected."""
        out: list[Task] = []
        for f in fs:
            try:
                out.append(self.submit(f, **args))
            except SlotsExhausted as e:
                if not out:
                    e.accepted = out
                    raise
                break
            except Stopped as e:
                e.accepted = out
                raise
        return out

    def submit_call(self, name: str | None = None, source: str | None = None, /, *args, **named) -> Task:
        """A task that calls a function by its qualified name, or runs source, with these arguments."""
        f = call(name, source)
        return self.submit(lambda: f(*args, **named))

    def stop(self) -> None:
        """Tasks that have not begun are lost."""
        with self.lock:
            self.stopped = True
        self.executor.shutdown(cancel_futures=True)
        for n in list(self.open):
            self.note("lost", n)
        self.open.clear()


def _helped(task: Task) -> None:
    """A task that waits inside its own pool runs one that has not begun itself, so that nested tasks cannot block one another."""
    if task.pool is not None and current_pool() is task.pool and task.future.cancel():
        done: Future = Future()
        try:
            done.set_result(task.run())
        except BaseException as e:  # noqa: BLE001  raised where it is collected
            done.set_exception(e)
        task.future = done


def collect(task: Task, timeout: float | None = None):
    """The value, once. A wait that ends early gives TIMEOUT and leaves the task as it is."""
    if task.spent:
        raise EngineError("the task has been collected")
    if task.dropped:
        task.spent = True
        raise Cancelled("the task was cancelled")
    _helped(task)
    try:
        value = task.future.result(timeout)
    except LostFuture:
        task.spent = True
        raise Stopped("the pool stopped before the task began") from None
    except Late:
        if not task.future.done():
            return TIMEOUT
        task.spent = True
        raise
    except BaseException:
        task.spent = True
        raise
    task.spent = True
    return value


def collect_any(tasks: list[Task], timeout: float | None = None):
    """(position from 1, value) of the first task that ended; of several, the earliest by position. Only that one is consumed."""
    wait([t.future for t in tasks], timeout, FIRST_COMPLETED)
    for k, t in enumerate(tasks, 1):
        if t.future.done():
            return k, collect(t)
    return TIMEOUT


def collect_all(tasks: list[Task], timeout: float | None = None):
    """All values in order; the first failure by position is raised with its index. A timeout consumes nothing."""
    for t in tasks:
        _helped(t)
    if wait([t.future for t in tasks], timeout).not_done:
        return TIMEOUT
    values, failed = [], None
    for k, t in enumerate(tasks, 1):
        try:
            values.append(collect(t))
        except BaseException as e:  # noqa: BLE001
            e.index = k
            failed = failed or e
    if failed:
        raise failed
    return values


def cancel(task: Task, hard: bool = False) -> bool:
    """Advisory: a queued task is skipped, a running one ends and its value is dropped. hard interrupts the Spark jobs of a running one."""
    if task.spent or task.dropped or (task.future.done() and not task.future.cancelled()):
        return False
    if task.future.cancel() and task.pool:
        task.pool.open.pop(task.id, None)
    elif hard and task.pool:
        task.pool.spark.sparkContext.cancelJobsWithTag(task.tag)
    task.dropped = True
    if task.pool:
        task.pool.note("drop", task.id)
    return True


def trace(pool: Pool, f: Callable[[str, int], None] | None) -> None:
    """Call f with each event and task id from now on; None ends it."""
    pool.watcher = f


def event_frame(pool: Pool) -> DataFrame:
    """(seq, task, event, at, worker) of all events so far."""
    return pool.spark.createDataFrame(list(pool.events), "seq long, task long, event string, at double, worker string")


def dump(events: DataFrame) -> DataFrame:
    """(task, state) from events (seq, task, event): a drop decides, else the last event does."""
    state = F.create_map(*[F.lit(x) for pair in _AFTER.items() for x in pair])
    last = events.groupBy("task").agg(F.max_by("event", "seq").alias("last"), F.bool_or(F.col("event") == "drop").alias("dropped"))
    return last.select("task", F.when(F.col("dropped"), "cancel").otherwise(state[F.col("last")]).alias("state"))


def info(events: DataFrame) -> DataFrame:
    """(state, n) over the tasks of events."""
    return state_counts(dump(events).select("state"))


def state_counts(states: DataFrame) -> DataFrame:
    """(state, n) from a column of states, or of their numbers."""
    c = states.columns[0]
    named = F.col(c) if dict(states.dtypes)[c] == "string" else F.element_at(F.array(*map(F.lit, STATES)), (F.col(c) + 1).cast("int"))
    return states.select(named.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def stats(events: DataFrame, by: str = "worker") -> DataFrame:
    """(worker, injected, claimed, queued) from events: what was submitted, what of it began, and what waits."""
    injected, claimed = F.count_if(F.col("event") == "submit"), F.count_if(F.col("event") == "start")
    return events.groupBy(by).agg(injected.alias("injected"), claimed.alias("claimed"), (injected - claimed).alias("queued"))


def snapshot(pool: Pool) -> dict:
    """What the pool holds now: workers, capacity, whether it has stopped, and how many tasks are in each state."""
    states = dict.fromkeys(STATES[1:], 0)
    last: dict[int, str] = {}
    for _, task, event, *_ in list(pool.events):
        if last.get(task) != "drop":
            last[task] = event
    for event in last.values():
        states["cancel" if event == "drop" else _AFTER[event]] += 1
    return {"workers": pool.workers, "capacity": pool.capacity, "stopped": pool.stopped, "tasks": states}


def first_ended(log: DataFrame) -> DataFrame:
    """(grp, position, ended) of the task that ended first in each group of a log (grp, pos, ended); of several, the earliest by position."""
    first = F.min(F.struct("ended", "pos")).alias("first")
    return log.groupBy("grp").agg(first).select("grp", F.col("first.pos").cast("long").alias("position"), F.col("first.ended").alias("ended"))


def first_failed(log: DataFrame) -> DataFrame:
    """(grp, index) of the first failure by position in each group of a log (grp, pos, failed); null without any."""
    return log.groupBy("grp").agg(F.min(F.when(F.col("failed"), F.col("pos"))).cast("long").alias("index"))


def in_order(log: DataFrame) -> DataFrame:
    """The rows of a log whose groups have no failure, ordered by position within each group: what collecting all of a group gives."""
    failed = log.where("failed").select("grp").distinct()
    return log.join(failed, "grp", "left_anti").drop("failed").repartition("grp").sortWithinPartitions("grp", "pos")


async def collect_async(task: Task, timeout: float | None = None):
    """collect() without holding up the event loop; a wait that ends early gives TIMEOUT and leaves the task as it is."""
    await asyncio.wait([asyncio.wrap_future(task.future)], timeout=timeout) if not task.dropped else None
    return collect(task, 0)


async def collect_all_async(tasks: list[Task], timeout: float | None = None):
    """collect_all() without holding up the event loop."""
    waits = [asyncio.wrap_future(t.future) for t in tasks if not t.dropped]
    await asyncio.wait(waits, timeout=timeout) if waits else None
    return collect_all(tasks, 0)


async def collect_any_async(tasks: list[Task], timeout: float | None = None):
    """collect_any() without holding up the event loop."""
    waits = [asyncio.wrap_future(t.future) for t in tasks if not t.dropped]
    await asyncio.wait(waits, timeout=timeout, return_when=asyncio.FIRST_COMPLETED) if waits else None
    return collect_any(tasks, 0)


_current: contextvars.ContextVar[Pool | None] = contextvars.ContextVar("pool", default=None)


def current_pool() -> Pool | None:
    return _current.get()


@contextmanager
def with_pool(pool: Pool):
    token = _current.set(pool)
    try:
        yield pool
    finally:
        _current.reset(token)


_default: list[Pool | None] = [None]


def set_default_pool(pool: Pool | None) -> Pool | None:
    """The pool that default_pool gives from now on; returns the one before."""
    before, _default[0] = _default[0], pool
    return before


def default_pool() -> Pool:
    """The pool of the running task or of with_pool, else the default one."""
    if (pool := current_pool() or _default[0]) is None:
        raise EngineError("there is no default pool")
    return pool


@contextmanager
def local_pool(spark: SparkSession, workers: int = 4, capacity: int | None = None):
    """A pool that is current inside the block and stops at its end, on an error too."""
    pool = Pool(spark, workers, capacity)
    try:
        with with_pool(pool):
            yield pool
    finally:
        pool.stop()
