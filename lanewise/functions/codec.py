"""Values as self-describing byte streams, for columns of BINARY that other programs read.

A stream is a header and one value; a value is a tag and a body, little-endian. Vectors are typed and hold None for a missing
element; a missing scalar is one of the NA constants. Values that the format cannot hold are declined with their path.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import partial
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame

from lanewise.operators.errors import EngineError, NotPortable
from lanewise.session import ship

# Fixed values of the format: header, tags, missing values, depth.
HEADER = b"\x49\x01"
NIL, LOGICAL, INT, REAL, TEXT, BYTES, LOGICALS, INTS, REALS, COMPLEXES, RAWS, TEXTS, LIST, DICT, INT64S, ATTR, COMPLEX, FAILURE, TASK, REF = range(20)
NA_32, NA_64, DEEPEST = -(1 << 31), -(1 << 63), 64


class BadStream(EngineError):
    """Bytes that are not a stream of this format."""


@dataclass(frozen=True)
class Missing:
    kind: str


NA_LOGICAL, NA_INT, NA_TEXT = Missing("logical"), Missing("int"), Missing("text")


@dataclass
class Vector:
    """kind: logical, int, real, complex, raw, text or int64."""

    kind: str
    values: list


@dataclass
class Attributed:
    """A value with attributes, such as levels and class of a factor."""

    value: object
    attributes: dict = field(default_factory=dict)


@dataclass
class Failure:
    """An error as a value; index is the element's, from 0, or None."""

    type: str
    message: str
    detail: str = ""
    index: int | None = None


@dataclass(frozen=True)
class Ref:
    """What stands for a large value kept elsewhere, by its identifier; only inside a task's arguments."""

    name: str


@dataclass
class TaskCall:
    """A call to run elsewhere: language is a number of LANGUAGES, kind says what code is, identity tells tasks apart."""

    language: int
    kind: int
    identity: int
    code: str
    args: list = field(default_factory=list)
    named: dict = field(default_factory=dict)


#: Languages, and the kinds of a task's code.
LANGUAGES, BY_NAME, BY_SOURCE, RUNNER = {1: "bytes", 2: "R", 3: "Python"}, 0, 1, 2

#: Vectors of a fixed width: tag, format of an element, what stands for None (nothing: None is declined).
FIXED = {"logical": (LOGICALS, "i", NA_32), "int": (INTS, "i", NA_32), "real": (REALS, "d", None), "int64": (INT64S, "q", NA_64)}
OF_TAG = {tag: (kind, form, na) for kind, (tag, form, na) in FIXED.items()}


def write(value: object) -> bytes:
    """The stream of a value. NotPortable has the path of what is declined, the reason and a remedy."""
    out = bytearray(HEADER)
    if isinstance(value, Failure):
        indexed = value.index is not None
        out += struct.pack("<BH", FAILURE, indexed) + (struct.pack("<Q", value.index) if indexed else b"")
        for s in (value.type, value.message, value.detail):
            _text(out, s)
    else:
        _put(out, value, "value", 0)
    return bytes(out)


def write_task(task: TaskCall) -> bytes:
    """The stream of a task. Its arguments may hold references."""
    if task.language not in LANGUAGES or task.kind not in (BY_NAME, BY_SOURCE, RUNNER) or not 0 <= task.identity < 1 << 64:
        raise _decline("task", "an unknown language or kind, or an identity beyond 64 bits", "name a known one")
    if not isinstance(task.code, str) or not isinstance(task.args, list) or not isinstance(task.named, dict):
        raise _decline("task", "a task has code, a list and a dictionary", "give all three")
    out = bytearray(HEADER) + struct.pack("<BBBHQ", TASK, task.language, task.kind, 0, task.identity)
    for value, path in ((task.code, "code"), (task.args, "args"), (task.named, "named")):
        _put(out, value, path, 0, refs=True)
    return bytes(out)


def _decline(path: str, reason: str, remedy: str = "send a plain value") -> NotPortable:
    return NotPortable(f"{path}: {reason}; {remedy}", path=path, reason=reason, remedy=remedy)


def _text(out: bytearray, s: str | None, path: str = "text") -> None:
    try:
        raw = b"" if s is None else s.encode()
    except UnicodeEncodeError as e:
        raise _decline(path, "text that has no UTF-8 form", "send bytes") from e
    out += struct.pack("<i", -1 if s is None else len(raw)) + raw


def _put(out: bytearray, v: object, path: str, depth: int, refs: bool = False) -> None:
    if depth > DEEPEST:
        raise _decline(path, f"deeper than {DEEPEST} levels", "flatten it")
    match v:
        case None:
            out.append(NIL)
        case bool():
            out += bytes((LOGICAL, v))
        case Missing("logical"):
            out += bytes((LOGICAL, 2))
        case Missing("int"):
            out += struct.pack("<Bq", INT, NA_64)
        case Missing("text"):
            out.append(TEXT)
            _text(out, None)
        case int():
            if not NA_64 < v < 1 << 63:
                raise _decline(path, "beyond 64 bits", "send text")
            out += struct.pack("<Bq", INT, v)
        case float():
            out += struct.pack("<Bd", REAL, v)
        case complex():
            out += struct.pack("<Bdd", COMPLEX, v.real, v.imag)
        case str():
            out.append(TEXT)
            _text(out, v, path)
        case bytes():
            out += struct.pack("<BQ", BYTES, len(v)) + v
        case Vector():
            _put_vector(out, v, path)
        case list() | tuple():
            out += struct.pack("<BQ", LIST, len(v))
            for k, x in enumerate(v):
                _put(out, x, f"{path}[{k}]", depth + 1, refs)
        case dict():
            _put_dict(out, v, path, depth, refs)
        case Ref() if refs and 0 < len(v.name.encode()) < 256:
            raw = v.name.encode()
            out += struct.pack("<BB", REF, len(raw)) + raw
        case Attributed():
            if reason := misshapen(v):
                raise _decline(path, reason)
            out.append(ATTR)
            _put(out, v.value, path, depth + 1)
            _put_dict(out, v.attributes, f"attributes of {path}", depth + 1)
        case Failure():
            raise _decline(path, "an error inside a value", "send it by itself")
        case _:
            raise _decline(path, f"no form for {type(v).__name__}")


def _put_dict(out: bytearray, v: dict, path: str, depth: int, refs: bool = False) -> None:
    out += struct.pack("<BQ", DICT, len(v))
    for k, x in v.items():
        if not isinstance(k, str):
            raise _decline(path, "a key that is not text", "name it")
        _text(out, k, path)
        _put(out, x, f"{path}[{k!r}]", depth + 1, refs)


def _put_vector(out: bytearray, v: Vector, path: str) -> None:
    n = len(v.values)
    if v.kind in FIXED:
        tag, form, na = FIXED[v.kind]
        if na is None and None in v.values:
            raise _decline(path, f"a missing element among {v.kind}", "send a NaN")
        try:
            out += struct.pack(f"<BQ{n}{form}", tag, n, *[na if x is None else x for x in v.values])
        except struct.error as e:
            raise _decline(path, f"an element that is not {v.kind}") from e
    elif v.kind == "complex":
        if None in v.values:
            raise _decline(path, "a missing element among complex", "send a NaN")
        try:
            out += struct.pack(f"<BQ{2 * n}d", COMPLEXES, n, *[y for x in v.values for y in (x.real, x.imag)])
        except (AttributeError, struct.error) as e:
            raise _decline(path, "an element that is not complex") from e
    elif v.kind == "raw":
        try:
            raw = bytes(v.values)
        except (TypeError, ValueError) as e:
            raise _decline(path, "an element that is not a byte") from e
        out += struct.pack("<BQ", RAWS, n) + raw
    elif v.kind == "text":
        out += struct.pack("<BQ", TEXTS, n)
        for x in v.values:
            if not isinstance(x, str | None):
                raise _decline(path, "an element that is not text")
            _text(out, x, path)
    else:
        raise _decline(path, f"no vectors of {v.kind}")


def _items(x: object) -> list:
    return x.values if isinstance(x, Vector) else [x] if isinstance(x, str) else []


def _length(x: object) -> int:
    return len(x.values) if isinstance(x, Vector) else len(x) if isinstance(x, list | tuple) else _length(x.value) if isinstance(x, Attributed) else 1


def misshapen(v: Attributed) -> str | None:
    """What is wrong with a value's attributes, if anything: factors have whole codes within distinct levels, shapes multiply to the length,
    days are whole, durations have a known unit, frames have columns of one length under distinct names, names are as many as elements."""
    a, n = v.attributes, _length(v.value)
    kind = _items(a.get("class"))
    if "factor" in kind:
        levels = _items(a.get("levels"))
        if not isinstance(v.value, Vector | int) or (isinstance(v.value, Vector) and v.value.kind != "int"):
            return "a factor whose codes are not whole"
        if None in levels or len(set(levels)) != len(levels):
            return "a factor whose levels are missing or repeated"
        if any(c is not None and not 1 <= c <= len(levels) for c in (v.value.values if isinstance(v.value, Vector) else [v.value])):
            return "a factor's code beyond its levels"
    if "dim" in a:
        dim = a["dim"].values if isinstance(a["dim"], Vector) else [a["dim"]]
        if any(d is None or d < 0 for d in dim) or prod(dim) != n:
            return "a shape that does not fit the length"
        if isinstance(v.value, Vector) and v.value.kind == "text":
            return "a matrix of text"
    if "Date" in kind and any(x is not None and x == x and x != int(x) for x in (v.value.values if isinstance(v.value, Vector) else [v.value])):
        return "a day that is not whole"
    if "difftime" in kind and a.get("units") not in ("secs", "mins", "hours", "days", "weeks"):
        return "a duration without a known unit"
    if "data.frame" in kind:
        names = _items(a.get("names"))
        if not isinstance(v.value, list | tuple) or len(names) != n or None in names or len(set(names)) != n:
            return "a frame whose names are missing or repeated"
        if len({_length(c) for c in v.value}) > 1:
            return "a frame of columns of different lengths"
    elif "names" in a and len(_items(a["names"])) != n:
        return "names that are not as many as the elements"
    return None


class _Reader:
    def __init__(self, raw: bytes, refs: bool = False):
        self.raw, self.at, self.refs = raw, 0, refs

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise BadStream("the stream ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def count(self, width: int) -> int:
        """A number of elements of at least so many bytes: it cannot exceed what is left, so no stream makes the reader allocate more."""
        (n,) = self.unpack("Q")
        if n * width > len(self.raw) - self.at:
            raise BadStream("a count beyond the stream")
        return n

    def text(self) -> str | None:
        (n,) = self.unpack("i")
        if n < -1:
            raise BadStream("a negative length")
        try:
            return None if n == -1 else self.take(n).decode()
        except UnicodeDecodeError as e:
            raise BadStream("text that is not UTF-8") from e

    def dict(self, depth: int) -> dict:
        out = {}
        for _ in range(self.count(5)):
            key = self.text()
            if key is None or key in out:
                raise BadStream("a missing or repeated key")
            out[key] = self.value(depth + 1)
        return out

    def value(self, depth: int) -> object:
        if depth > DEEPEST:
            raise BadStream("a stream too deep")
        (tag,) = self.unpack("B")
        if tag in OF_TAG:
            kind, form, na = OF_TAG[tag]
            n = self.count(struct.calcsize("<" + form))
            got = list(self.unpack(f"{n}{form}"))
            if na is not None:
                got = [None if x == na else x for x in got]
            if kind == "logical":
                if any(x not in (0, 1, None) for x in got):
                    raise BadStream("a logical that is not 0, 1 or missing")
                got = [None if x is None else bool(x) for x in got]
            return Vector(kind, got)
        return self.others(tag, depth)

    def others(self, tag: int, depth: int) -> object:
        match tag:
            case 0:
                return None
            case 1:
                (x,) = self.unpack("B")
                if x > 2:
                    raise BadStream("a logical that is not 0, 1 or missing")
                return NA_LOGICAL if x == 2 else bool(x)
            case 2:
                (x,) = self.unpack("q")
                return NA_INT if x == NA_64 else x
            case 3:
                return self.unpack("d")[0]
            case 4:
                return NA_TEXT if (s := self.text()) is None else s
            case 5:
                return self.take(self.count(1))
            case 9:
                x = self.unpack(f"{2 * self.count(16)}d")
                return Vector("complex", [complex(a, b) for a, b in zip(x[::2], x[1::2], strict=True)])
            case 10:
                return Vector("raw", list(self.take(self.count(1))))
            case 11:
                return Vector("text", [self.text() for _ in range(self.count(4))])
            case 12:
                return [self.value(depth + 1) for _ in range(self.count(1))]
            case 13:
                return self.dict(depth)
            case 15:
                inner = self.value(depth + 1)
                if self.unpack("B") != (DICT,):
                    raise BadStream("attributes that are no dictionary")
                out = Attributed(inner, self.dict(depth + 1))
                if reason := misshapen(out):
                    raise BadStream(reason)
                return out
            case 16:
                return complex(*self.unpack("dd"))
            case 19 if self.refs:
                (n,) = self.unpack("B")
                if not n:
                    raise BadStream("a reference to nothing")
                try:
                    return Ref(self.take(n).decode())
                except UnicodeDecodeError as e:
                    raise BadStream("text that is not UTF-8") from e
        raise BadStream(f"tag {tag} at the place of a value")

    def failure(self) -> Failure:
        (flags,) = self.unpack("H")
        if flags > 1:
            raise BadStream("unknown flags")
        index = self.unpack("Q")[0] if flags else None
        said = [self.text() for _ in range(3)]
        if None in said:
            raise BadStream("an error without its texts")
        return Failure(*said, index)


def read(raw: bytes) -> object:
    """The value of a stream, or a Failure. BadStream for anything else: every length is checked before it is used."""
    r = _Reader(raw)
    if r.take(2) != HEADER:
        raise BadStream("no header")
    if raw[2:3] == bytes((FAILURE,)):
        r.at = 3
        out = r.failure()
    else:
        out = r.value(0)
    if r.at != len(raw):
        raise BadStream("bytes after the value")
    return out


def read_task(raw: bytes) -> TaskCall:
    """The task of a stream, which is no value."""
    r = _Reader(raw, refs=True)
    if r.take(2) != HEADER or r.take(1) != bytes((TASK,)):
        raise BadStream("no task")
    language, kind, flags, identity = r.unpack("BBHQ")
    if language not in LANGUAGES or kind not in (BY_NAME, BY_SOURCE, RUNNER) or flags:
        raise BadStream("an unknown language, kind or flag")
    code, args, named = (r.value(0) for _ in range(3))
    if not isinstance(code, str) or not isinstance(args, list) or not isinstance(named, dict):
        raise BadStream("a task without code, a list and a dictionary")
    if r.at != len(raw):
        raise BadStream("bytes after the task")
    return TaskCall(language, kind, identity, code, args, named)


def run_task(task: TaskCall, refs: dict[str, object] | None = None) -> object:
    """The value of a task for Python, by name or by source; references are looked up."""
    from lanewise.operators.element import call

    if task.language != 3 or task.kind == RUNNER:
        raise NotPortable(f"a task for {LANGUAGES[task.language]} or of a runner cannot run here", reason="language")

    def found(v: object) -> object:
        if isinstance(v, Ref):
            if v.name not in (refs or {}):
                raise EngineError(f"nothing is kept under {v.name}")
            return refs[v.name]
        if isinstance(v, Vector):
            return v.values
        return [found(x) for x in v] if isinstance(v, list) else {k: found(x) for k, x in v.items()} if isinstance(v, dict) else v

    f = call(task.code) if task.kind == BY_NAME else call(source=task.code)
    return f(*found(task.args), **found(task.named))


def _rows(f, name: str, kind: pa.DataType, batches):
    for batch in batches:
        ix, x = batch.columns
        yield pa.RecordBatch.from_arrays([ix, pa.array([f(v) for v in x.to_pylist()], kind)], names=["ix", name])


def pack(table: DataFrame) -> DataFrame:
    """(ix, stream) of a table (ix, x); arrays are lists, structs and maps with text keys dictionaries, null is nil."""
    ship(table.sparkSession)
    return table.select("ix", "x").mapInArrow(partial(_rows, write, "stream", pa.binary()), "ix long, stream binary")


def unpack(table: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """(ix, x) of (ix, stream), as values of one declared type."""
    ship(table.sparkSession)
    return table.select("ix", "stream").mapInArrow(partial(_rows, read, "x", arrow), f"ix long, x {kind}")
