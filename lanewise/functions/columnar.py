"""Whole columns as byte streams of the codec, from and to Arrow buffers: no Python object for an element but the lengths of texts read.

A stream holds one vector, byte by byte as codec.write gives it for the same values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lanewise.operators.errors import NotPortable
from lanewise.session import ship

from .codec import HEADER, INT64S, INTS, LOGICALS, NA_32, NA_64, RAWS, REALS, TEXTS, BadStream

#: Arrow types of a fixed width: tag, the width written, what stands for a missing element.
_FIXED = {"bool": (LOGICALS, "<i4", NA_32), "int8": (INTS, "<i4", NA_32), "int16": (INTS, "<i4", NA_32), "uint16": (INTS, "<i4", NA_32), "int32": (INTS, "<i4", NA_32), "int64": (INT64S, "<i8", NA_64), "float": (REALS, "<f8", None), "double": (REALS, "<f8", None)}
_READ = {LOGICALS: ("<i4", NA_32), INTS: ("<i4", NA_32), INT64S: ("<i8", NA_64), REALS: ("<f8", None)}


def _decline(why: str, path: str, remedy: str = "convert it first") -> NotPortable:
    return NotPortable(f"{path}: {why}; {remedy}", path=path, reason=why, remedy=remedy)


def write_array(array: pa.Array, path: str = "value") -> bytes:
    """The stream of an array. Types without a form, missing numbers of floating point and missing bytes decline with the column's name."""
    kind, n = str(array.type), len(array)
    if kind in _FIXED:
        tag, width, na = _FIXED[kind]
        if na is None and array.null_count:
            raise _decline("a missing element among real", path, "send a NaN")
        wide = array.cast(pa.int32()) if kind == "bool" else array
        out = (wide.fill_null(0) if array.null_count else wide).to_numpy(zero_copy_only=False).astype(width)
        if array.null_count:
            out[array.is_null().to_numpy(zero_copy_only=False)] = na
        return HEADER + struct.pack("<BQ", tag, n) + out.tobytes()
    if kind == "uint8":
        if array.null_count:
            raise _decline("a missing element among raw", path)
        return HEADER + struct.pack("<BQ", RAWS, n) + array.to_numpy().tobytes()
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        return HEADER + struct.pack("<BQ", TEXTS, n) + _texts(array.cast(pa.large_string()))
    raise _decline(f"no vectors of {kind}", path)


def _texts(array: pa.Array) -> bytes:
    """Each text's length, -1 for a missing one, then its bytes: lengths and texts joined element by element share one buffer."""
    n, empty = len(array), pa.scalar(b"", pa.large_binary())
    if not n:
        return b""
    texts = array.cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(texts), -1).to_numpy().astype("<i4")
    lengths = pa.Array.from_buffers(pa.binary(4), n, [None, pa.py_buffer(size.tobytes())]).cast(pa.large_binary())
    joined = pc.binary_join_element_wise(lengths, pc.fill_null(texts, empty), empty)
    _, ends, data = joined.buffers()
    first, last = (int(x) for x in np.frombuffer(ends, "<i8", n + 1, joined.offset * 8)[[0, -1]])
    return data.slice(first, last - first).to_pybytes()


def read_array(raw: bytes) -> pa.Array:
    """The array of a stream that holds one vector; missing elements by a validity mask. BadStream for anything else."""
    if raw[:2] != HEADER or len(raw) < 11:
        raise BadStream("no stream of a vector")
    tag, n = struct.unpack_from("<BQ", raw, 2)
    if tag in _READ:
        width, na = _READ[tag]
        if len(raw) != 11 + n * int(width[2]):
            raise BadStream("a vector of another length")
        x = np.frombuffer(raw, width, n, 11)
        if tag == LOGICALS:
            if not np.isin(x, (0, 1, na)).all():
                raise BadStream("a logical element that is none")
            return pa.array(x == 1, pa.bool_(), mask=x == na)
        return pa.array(x, mask=None if na is None else x == na)
    if tag == RAWS:
        if len(raw) != 11 + n:
            raise BadStream("a vector of another length")
        return pa.array(np.frombuffer(raw, np.uint8, n, 11))
    if tag == TEXTS:
        if n > (len(raw) - 11) // 4:
            raise BadStream("a vector of another length")
        size, at = np.empty(n, np.int64), 11
        for k in range(n):
            (size[k],) = struct.unpack_from("<i", raw, at) if at + 4 <= len(raw) else (-2,)
            at += 4 + max(0, int(size[k]))
            if size[k] < -1 or at > len(raw):
                raise BadStream("a text of another length")
        if at != len(raw):
            raise BadStream("bytes after the value")
        missing, size = size < 0, np.maximum(size, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        starts = 11 + np.cumsum(size + 4) - size
        own = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        data = np.frombuffer(raw, np.uint8)[np.repeat(starts, size) + own]
        mask = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes()) if missing.any() else None
        out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(data.tobytes()), mask)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid as e:
            raise BadStream("text that is no UTF-8") from e
        return out
    raise BadStream(f"no vector: tag {tag}")


_PACKED = "part int, batch int, column string, n long, stream binary"


def pack_columns(df: DataFrame) -> DataFrame:
    """part, batch, column, n and stream: each column of each Arrow batch of the frame as one stream, written where the batch is."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            m = b.num_columns
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([k] * m, pa.int32()), pa.array(b.schema.names), pa.array([b.num_rows] * m, pa.int64()), pa.array([write_array(c, n) for n, c in zip(b.schema.names, b.columns, strict=True)], pa.binary())], names=["part", "batch", "column", "n", "stream"])

    return df.mapInArrow(run, _PACKED)


def unpack_columns(packed: DataFrame, schema: str) -> DataFrame:
    """The frame of packed columns, in the types of schema. A batch's columns meet in one task, as rows of the streams' size."""
    ship(packed.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for part, batch, column, stream in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (part, batch) != now:
                    now, held = (part, batch), {}
                held[column] = read_array(stream)
                if len(held) == len(kinds):
                    yield pa.RecordBatch.from_arrays([held[f.name].cast(f.type) for f in kinds], schema=kinds)
                    held = {}

    return packed.repartition("part", "batch").sortWithinPartitions("part", "batch").mapInArrow(run, schema)
