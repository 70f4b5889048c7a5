"""Message streams over Structured Streaming, and their order and batch rules."""

from __future__ import annotations

import asyncio
import json
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise.operators.errors import CLOSED, FULL, PEER_GONE, TIMEOUT, EngineError, RemoteError, is_sentinel

from .log import Log, read_log, segments

#: Messages of a burst that a handler is given at once.
BURST = 2048


#: Seconds between looks at a stream, and without messages after which it stops until there are some.
LOOK, IDLE = 0.1, 2.0


class Channel:
    """A peer that handles batches of a message log in order: each send is one segment of the log, taken at most `quantum` at a time.

    One stream runs as long as there are messages, and goes on from its checkpoint when there are some again, in another process too. What
    the peer makes of a batch is written below the checkpoint folder and given out once the batch is done, so a batch that fails gives
    nothing and none is given twice. After the peer's error, which is received as a value, the channel is at its end. folder and checkpoint
    are paths that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, f: Callable[[DataFrame], DataFrame], checkpoint: str, capacity: int = 64, quantum: int = 1):
        if capacity < 1 or quantum < 1:
            raise EngineError("a channel has room for one message, and takes one batch at least")
        self.spark, self.folder, self.schema, self.capacity = spark, folder, StructType.fromDDL(schema), capacity
        self.f, self.checkpoint, self.quantum = f, checkpoint, quantum
        self.sent, self.closed, self.gone, self.out = 0, False, False, deque()
        self.accepted = self.received = self.batches = 0
        # The lock guards the counts, for no longer than it takes to change them.
        self.lock, self.arrived = threading.RLock(), threading.Condition()
        self.done: set[int] = set()
        self.log, self.running, self.handler = Log(folder, self.schema), None, None
        # What an earlier process sent and no stream has handled.
        self.before = bool(segments(self.log.fs, self.log.at))

    def __repr__(self) -> str:
        return f"<channel, {len(self.out)} to receive, {self.sent} sent, {'closed' if self.closed else 'open'}>"

    def send_batch(self, rows: list[tuple]):
        """How many messages were accepted, at once, whatever the peer does. CLOSED once the channel is closed, PEER_GONE after its error."""
        with self.lock:
            if self.closed or self.gone:
                return CLOSED if self.closed else PEER_GONE
            now = rows[: max(0, self.capacity - len(self.out) - self.sent)]
            if now:
                self.log.append(now)
                self.sent += len(now)
                self.accepted += len(now)
        with self.arrived:
            self.arrived.notify_all()
        return len(now)

    def send(self, row: tuple):
        """None, or FULL, CLOSED or PEER_GONE."""
        n = self.send_batch([row])
        return n if is_sentinel(n) else None if n else FULL

    def take(self, df: DataFrame, batch: int) -> None:
        """One batch of the stream, in its thread: the peer's work is done and written before any of it is given out."""
        self.f(df).write.mode("overwrite").parquet(self.place(batch))
        given = [tuple(r) for r in self.spark.read.parquet(self.place(batch)).orderBy("seq").toLocalIterator()]
        with self.lock:
            if batch not in self.done:
                self.done.add(batch)
                self.batches += 1
                self.out.extend(given)
            self.sent -= self.log.handled(self.offset(batch))
        with self.arrived:
            self.arrived.notify_all()

    def offset(self, batch: int) -> int:
        """The segment before which a batch of the stream ends."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/offsets/{batch}")
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return json.loads(text.splitlines()[-1])["segment"]

    def begin(self) -> None:
        """See that the stream runs."""
        with self.lock:
            if self.gone or (self.running and self.running.is_alive()):
                return
            self.running = threading.Thread(target=self.run, daemon=True)
            self.running.start()

    def run(self) -> None:
        """The stream, until there has been nothing to do for a while, or the peer's error."""
        error, idle = None, 0.0
        try:
            stream = read_log(self.spark, self.folder, self.schema, self.quantum)
            query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", self.checkpoint).trigger(processingTime=f"{int(LOOK * 1000)} milliseconds").start()
            while not query.awaitTermination(LOOK):
                busy = self.sent or query.status["isTriggerActive"] or self.before and segments(self.log.fs, self.log.at) and idle < 2 * IDLE
                idle = 0.0 if self.sent or query.status["isTriggerActive"] else idle + LOOK
                if not busy and idle > IDLE:
                    self.before = False
                    query.stop()
        except Exception as e:  # noqa: BLE001  the peer's error is delivered as a value
            error = RemoteError(str(e))
        with self.lock:
            if error:
                self.out.append(error)
                self.gone, self.sent = True, 0
        with self.arrived:
            self.arrived.notify_all()

    def drain(self) -> None:
        """Wait until the peer has handled all that has been sent so far."""
        while (self.sent or self.before) and not self.gone:
            self.begin()
            with self.arrived:
                self.arrived.wait(LOOK)

    def place(self, batch: int) -> str:
        return f"{self.checkpoint}/given/batch={batch}"

    def end(self):
        return PEER_GONE if self.gone and not self.closed else CLOSED

    def recv_batch(self, n: int, timeout: float | None = 0):
        """From 1 to n messages in order, without waiting to fill; CLOSED after the last, PEER_GONE after the peer's error. Without any it waits
        for the time given, None for ever, and gives TIMEOUT; with 0, as it stands, an empty list."""
        limit = None if timeout is None else time.monotonic() + timeout
        while not self.out:
            if self.sent or self.before:
                if timeout == 0:
                    self.drain()
                    continue
                self.begin()
            elif self.closed or self.gone:
                return self.end()
            left = None if limit is None else limit - time.monotonic()
            if left is not None and left <= 0:
                return TIMEOUT if timeout else []
            with self.arrived:
                if not self.out:
                    self.arrived.wait(0.2 if left is None else min(left, 0.2))
        out = [self.out.popleft() for _ in range(min(n, len(self.out)))]
        self.received += len(out)
        return out

    def recv(self, timeout: float | None = None):
        """The next message in order, an error of the peer as a value, or TIMEOUT, CLOSED or PEER_GONE."""
        if timeout == 0:
            got = self.recv_batch(1, 0)
            return TIMEOUT if got == [] else got if is_sentinel(got) else got[0]
        got = self.recv_batch(1, timeout)
        return got if is_sentinel(got) else got[0]

    async def recv_async(self, timeout: float | None = None):
        """recv() without holding up the event loop; those that wait are served in the order in which they asked."""
        return await self._asked(lambda: self.recv(timeout))

    async def recv_batch_async(self, n: int, timeout: float | None = None):
        """recv_batch() without holding up the event loop."""
        return await self._asked(lambda: self.recv_batch(n, timeout))

    async def _asked(self, f: Callable):
        if self.handler is not None:
            raise EngineError("the channel has a handler")
        if not hasattr(self, "askers"):
            self.askers = ThreadPoolExecutor(1)
        return await asyncio.wrap_future(self.askers.submit(f))

    def recv_handler(self, fn: Callable, batch: bool = False) -> threading.Thread:
        """Call fn with each message, or with bursts of them, until the end, whose sentinel it is given last. An error in fn ends it. While it
        runs nothing else receives."""
        if self.handler is not None and self.handler.is_alive():
            raise EngineError("the channel has a handler")

        def run() -> None:
            try:
                while not is_sentinel(got := self.recv_batch(BURST, None)):
                    for x in [got] if batch else got:
                        fn(x)
                fn(got)
            finally:
                self.handler = None

        self.handler = threading.Thread(target=run, daemon=True)
        self.handler.start()
        return self.handler

    def close(self) -> None:
        """No more messages are accepted; what was sent can be received."""
        self.closed = True
        with self.arrived:
            self.arrived.notify_all()

    def alive(self) -> bool:
        return not self.closed and not self.gone

    def info(self) -> dict:
        return {"capacity": self.capacity, "quantum": self.quantum, "accepted": self.accepted, "received": self.received, "waiting": len(self.out), "sent": self.sent, "batches": self.batches, "closed": self.closed, "peer_gone": self.gone}


def next_batch(messages: DataFrame, after: int, n: int, seq: str = "seq") -> DataFrame:
    """The next n messages in order, from a number on: one batch of a table of messages."""
    return messages.where(F.col(seq) >= after).orderBy(seq).limit(n)
