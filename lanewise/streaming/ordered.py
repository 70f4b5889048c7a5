"""Delivery in order by key: messages of many channels, arriving in any order, come out of each channel by their sequence numbers.

Each channel keeps what it waits for next and the messages that arrived ahead of a gap. A gap that closes lets out all that stood behind
it; the message that closes a channel comes out behind all others of it, and nothing after it. Channels go on side by side, each in one
task, as order within a channel asks for. Without a timeout, channels named by strings or whole numbers share their calls in groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lanewise.operators.errors import EngineError
from lanewise.session import ship

MESSAGE, CLOSED, TIMEOUT = "message", "closed", "timeout"
_STATE = "channels binary, held binary"
#: Groups that channels are dealt into: those of one group are worked on in one call, as a call costs far more than a channel in it.
LANES = 1 << 9


def packed(columns: dict[str, np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as f:
        f.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(held).read_all()
    return {n: c.to_pandas().to_numpy() if pa.types.is_nested(c.type) else c.to_numpy() for n, c in zip(table.column_names, table.columns, strict=True)}


def places(lane: np.ndarray, seqs: np.ndarray, ends: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of messages of the channels lane, of which all below after[lane] have come out: the places of what may come out, channel by channel in
    order; which of these close their channel; the places of what waits on; and which channels are closed now."""
    order = np.lexsort((seqs, lane))
    own, known = lane[order], seqs[order]
    fresh = known >= after[own]
    fresh[1:] &= (known[1:] != known[:-1]) | (own[1:] != own[:-1])
    order, own, known = order[fresh], own[fresh], known[fresh]
    first = np.append(True, own[1:] != own[:-1])[: len(own)]
    place = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    ready = known == after[own] + place
    last = np.full(len(after), np.iinfo(np.int64).max)
    if ends is not None:
        closing = ready & np.where(pd.isna(ends), False, ends).astype(bool)[order]
        np.minimum.at(last, own[closing], place[closing])
    closed = last < np.iinfo(np.int64).max
    out = ready & (place <= last[own])
    return order[out], place[out] == last[own[out]], order[~out & ~closed[own]], closed


def let_out(rows: pd.DataFrame, seq: str, closes: str | None, after: int) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """(what may come out, what waits on, whether the channel is closed) of the messages known, when all below after have come out. A number
    that arrives again is the same message."""
    out, _, rest, closed = places(np.zeros(len(rows), np.int64), rows[seq].to_numpy(), rows[closes].to_numpy() if closes else None, np.array([after]))
    return rows.iloc[out], rows.iloc[rest], bool(closed[0])


def in_order(messages: DataFrame, channel: str = "channel", seq: str = "seq", closes: str | None = None, first: int = 0, timeout: int | None = None) -> DataFrame:
    """channel, at, kind and the messages' other columns, for a streaming frame of messages: at counts what each channel has given from 1 on, in
    the order of seq, which starts at first and has no gaps once all have arrived. Repeated numbers come out once; null numbers are an error.

    closes names a boolean column that is true for the message that ends its channel: it comes out as kind closed, last, and what arrives
    for the channel afterwards is left out. With a timeout, in milliseconds, a channel that waits so long for its next message gives a row
    of kind timeout with that message's number, once for each wait, and goes on waiting."""
    if not messages.isStreaming:
        raise EngineError("delivery in order is for streams; a table is sorted by its numbers")
    ship(messages.sparkSession)
    fields = [f for f in messages.schema.fields if f.name != channel]
    own = next(f for f in messages.schema.fields if f.name == channel)
    # Whole numbers of 64 bits go with a mark for the missing ones: a frame would make doubles of both.
    names = [f"c{k}" for k in range(len(fields))]
    marked = {f"n{k}": f"c{k}" for k, f in enumerate(fields) if f.dataType == LongType() and f.name != seq}
    seq_, closes_ = (next((n for n, f in zip(names, fields, strict=True) if f.name == x), None) for x in (seq, closes))
    sent = messages.select(F.col(channel).alias("channel"), *[F.col(f.name).alias(n) for n, f in zip(names, fields, strict=True)])
    for mark, n in marked.items():
        sent = sent.withColumn(mark, F.col(n).isNull()).withColumn(n, F.coalesce(n, F.lit(0)))
    columns = [*names, *marked]
    shared = timeout is None and own.dataType in (StringType(), LongType(), IntegerType())
    given = StructType([own_field("channel", own), StructField("at", LongType()), StructField("kind", StringType()), *[own_field(n, f) for n, f in zip(names, fields, strict=True)], *[StructField(m, BooleanType()) for m in marked]])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = not shared or int(key[0]) < 0
        then, waiting = map(unpacked, state.get) if state.exists else ({"next": np.full(int(one), first, np.int64), "given": np.zeros(int(one), np.int64), "closed": np.zeros(int(one), bool)}, None)
        if state.hasTimedOut:
            at = int(then["given"][0])
            row = {n: np.array([int(then["next"][0]) if n == seq_ else None], dtype=object) for n in names} | {m: np.array([True]) for m in marked}
            yield pd.DataFrame({"channel": [key[0]], "at": [at + 1], "kind": [TIMEOUT], **row})
            state.update((packed(then | {"given": np.array([at + 1])}), packed(waiting)))
            return
        known = [waiting] if waiting else []
        known += [{n: f[n].to_numpy() for n in columns if one or n != "channel"} | ({} if one else {"channel": f["channel"].to_numpy()}) for f in frames]
        rows = {n: np.concatenate([c[n] for c in known]) for n in known[0]} if len(known) > 1 else known[0]
        if one:
            lane, channels = np.zeros(len(rows[seq_]), np.int64), np.array([None], object)
        else:
            old = then.get("channel", rows["channel"][:0])
            lane, channels = pd.factorize(np.concatenate([old, rows["channel"]]))
            lane, more = lane[len(old) :], len(channels) - len(old)
            then = {"next": np.append(then["next"], np.full(more, first)), "given": np.append(then["given"], np.zeros(more, np.int64)), "closed": np.append(then["closed"], np.zeros(more, bool)), "channel": channels}
        if then["closed"].any():
            left = ~then["closed"][lane]
            lane, rows = lane[left], {n: x[left] for n, x in rows.items()}
        if (lost := pd.isna(rows[seq_])).any():
            raise EngineError(f"a message of channel {(key[0] if one else channels[lane[lost.argmax()]])} has no number")
        out, ends, rest, closed = places(lane, rows[seq_], rows[closes_] if closes_ else None, then["next"])
        if len(out):
            n = np.bincount(lane[out], minlength=len(then["next"]))
            at = then["given"][lane[out]] + rows[seq_][out] - then["next"][lane[out]] + 1
            of = [None if shared else key[0]] * len(out) if one else rows["channel"][out]
            yield pd.DataFrame({"channel": of, "at": at, "kind": np.where(ends, CLOSED, MESSAGE), **{c: rows[c][out] for c in columns}})
            then |= {"next": then["next"] + n, "given": then["given"] + n}
        state.update((packed(then | {"closed": then["closed"] | closed}), packed({n: x[rest] for n, x in rows.items()})))
        if timeout is not None and not closed[0] and not then["closed"][0]:
            state.setTimeoutDuration(timeout)

    clock = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    lane = F.when(F.col("channel").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("channel"), F.lit(LANES)))
    grouped = sent.withColumn("lane", lane).groupBy("lane") if shared else sent.groupBy("channel")
    out = grouped.applyInPandasWithState(run, given, StructType.fromDDL(_STATE), "append", clock)
    value = {n: F.when(~F.col(m), F.col(n)) for m, n in marked.items()}
    return out.select(F.col("channel").alias(channel), "at", "kind", *[value.get(n, F.col(n)).alias(f.name) for n, f in zip(names, fields, strict=True)])


def own_field(name: str, field: StructField) -> StructField:
    return StructField(name, field.dataType)
