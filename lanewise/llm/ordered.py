"""Rows in one order over all tasks, and what crosses from one task to the next.

Rows are dealt by ranges of (key, place in the key) and sorted, so a key with very many rows is spread over neighbouring tasks. Only a
task's first and last key can go on in another one: the driver reads a row or two for each task, never one for each key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small


def in_order(df: DataFrame, place: list[str], *within: str, n: int | None = None) -> DataFrame:
    """The rows by place, nulls first, then by within, in a checkpoint whose partitions follow one another; part is a partition's number.
    Rows of one place stay in one partition."""
    dealt = df.repartitionByRange(n or partitions(df), *place).sortWithinPartitions(*place, *within)
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal rows of keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def edges(rows: DataFrame, key: list[str]) -> dict[int, tuple]:
    """For each partition of rows in order its first key, the rows of it, its last key, and the rows of that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        n_first = n_last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(key))]
            part = batch.column(len(key))[0].as_py()
            starts = runs(cols)
            for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(cols[0])), strict=True)):
                if 0 < k < len(starts) - 1:
                    continue  # neither the first nor the last of the batch
                own = tuple(int(c[a]) for c in cols)
                n_last = n_last + int(b - a) if own == last else int(b - a)
                last = own
                first = own if first is None else first
                if own == first:
                    n_first = n_last
        if part is not None:
            values, keys = (part, list(first), n_first, list(last), n_last), pa.list_(pa.int64())
            kinds = (pa.int32(), keys, pa.int64(), keys, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["part", "first", "n_first", "last", "n_last"])

    found = small(rows.select(*key, "part")).mapInArrow(run, "part int, first array<long>, n_first long, last array<long>, n_last long")
    return {p: (tuple(a), n, tuple(b), m) for p, a, n, b, m in sorted(map(tuple, found.collect()))}


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows in order (see in_order), with name, the number of a row within its key from 1 on. The key is a long without nulls."""
    before, open_key, so_far = {}, None, 0
    for part, (first, n, last, m) in edges(rows, [key]).items():
        before[part] = so_far if first == open_key else 0
        so_far = before[part] + n if first == last else m
        open_key = last
    shared = rows.sparkSession.sparkContext.broadcast(before)
    at, part_at = rows.columns.index(key), rows.columns.index("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at).to_numpy()
            if last is None:
                last, have = own[0], shared.value[batch.column(part_at)[0].as_py()]
            starts = runs([own])
            sizes = np.diff(np.append(starts, len(own)))
            place = np.arange(1, len(own) + 1) - np.repeat(starts, sizes)
            if own[0] == last:
                place[: sizes[0]] += have
            last, have = own[-1], place[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, name])

    return small(rows).mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {name} long")


def joined_pieces(pieces: DataFrame, key: list[str], sep: bytes) -> DataFrame:
    """key, digest (SHA-256 in lowercase hex) of the pieces of each key by part, sep between them; a null piece is none. One task hashes
    a key's bytes, as SHA-256 takes them in order; it holds one piece at a time."""
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, some = None, None, False
        for batch in batches:
            out = []
            for *own, piece in zip(*(batch.column(k).to_pylist() for k in range(n)), batch.column(n + 1).to_pylist(), strict=True):
                if own != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h, some = own, hashlib.sha256(), False
                if piece is not None:
                    h.update(sep + piece if some else piece)
                    some = True
            yield _digests(key, out)
        if now is not None:
            yield _digests(key, [(*now, h.hexdigest())])

    dealt = pieces.select(*key, "part", "piece").repartition(partitions(pieces), *key).sortWithinPartitions(*key, "part")
    return small(dealt).mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", digest string")


def _digests(key: list[str], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * (len(key) + 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=[*key, "digest"])


def ordered_digests(df: DataFrame, key: list[str], number: str, sep: bytes = b",") -> DataFrame:
    """key and digest: SHA-256 in hex of each key's numbers in decimal, ascending, with sep between. key and number are longs without nulls.

    A key that lies in one task is hashed there; of one that goes on in others each task makes one piece, and the pieces are hashed in order."""
    rows = in_order(df.select(*key, number), [*key, number])
    found = edges(rows, key)
    crossing, order = {p: set() for p in found}, list(found)
    for p, q in zip(order, order[1:], strict=False):
        if found[p][2] == found[q][0]:
            crossing[p].add(found[p][2])
            crossing[q].add(found[q][0])
    shared, n = df.sparkSession.sparkContext.broadcast(crossing), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def ended(out: list) -> None:
            if now is not None:
                data = sep.join(parts)
                whole = now not in shared.value[part]
                out.append((*now, part, None if whole else data, hashlib.sha256(data).hexdigest() if whole else None))

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            part = batch.column(n + 1)[0].as_py()
            cols = [batch.column(k).to_numpy() for k in range(n)]
            text = batch.column(n).cast(pa.string()).to_pylist()
            starts = runs(cols)
            for a, b in zip(starts, np.append(starts[1:], len(text)), strict=True):
                own = tuple(int(c[a]) for c in cols)
                if own != now:
                    ended(out)
                    now, parts = own, []
                parts += [x.encode() for x in text[a:b]]
            yield _pieces(key, out)
        out = []
        ended(out)
        yield _pieces(key, out)

    made = cut(small(rows).mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", part int, piece binary, digest string"))
    over = joined_pieces(made.where("piece is not null"), key, sep)
    return made.where("digest is not null").select(*key, "digest").unionByName(over)


def _pieces(key: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * len(key), pa.int32(), pa.binary(), pa.string()]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*key, "part", "piece", "digest"])
