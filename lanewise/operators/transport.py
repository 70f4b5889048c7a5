"""Errors that cross from a worker: their classes, message and fields as a byte stream within a budget."""

from __future__ import annotations

from lanewise.functions import codec

from .errors import NotPortable, RemoteError

#: What stands for a message that doesn't fit.
FALLBACK = "the error's message does not fit"


def _size(value: object) -> int | None:
    """Bytes of the value's stream without its header, None if the format cannot hold it."""
    try:
        return len(codec.write(value)) - len(codec.HEADER)
    except NotPortable:
        return None


def flatten(error: BaseException, budget: int) -> bytes:
    """A stream of {classes, message, fields, dropped_fields} of at most budget bytes, if the classes fit at all.

    The message has at most half the budget and is cut beyond. Named fields of the error are kept in their order, each while it fits;
    those that the format cannot hold or that don't fit are named in dropped_fields, as many names as fit."""
    classes = [c.__name__ for c in type(error).__mro__ if c is not object]
    message = str(error).encode(errors="replace")[: budget // 2].decode(errors="ignore")
    parts = {"classes": classes, "message": message, "fields": {}}
    # What an entry adds to a dict, or to a list, is what it takes by itself: sizes are added up, and the stream is written once.
    size = len(codec.write(parts))
    dropped: list[tuple[str, int]] = []
    for name, value in vars(error).items():
        own, key = _size(value), _size(name)
        if key is None:
            continue
        if own is not None and size + (key - 1) + own <= budget:
            parts["fields"][name] = value
            size += key - 1 + own
        else:
            dropped.append((name, key))
    if size > budget:
        parts |= {"message": FALLBACK, "fields": {}}
        size = len(codec.write(parts))
    if dropped:
        size += len(codec.write(parts | {"dropped_fields": []})) - len(codec.write(parts))
        names = []
        for name, key in dropped:
            if (size := size + key) > budget:
                break
            names.append(name)
        if names:
            parts["dropped_fields"] = names
    return codec.write(parts)


def restored(stream: bytes, index: int | None = None) -> RemoteError:
    """The error to raise where the stream arrives: RemoteError with classes, fields and dropped_fields."""
    d = codec.read(stream)
    names = lambda v: list(v.values) if isinstance(v, codec.Vector) else list(v)
    return RemoteError(f"{names(d['classes'])[0]}: {d['message']}", classes=names(d["classes"]), fields=dict(d["fields"]), dropped_fields=names(d.get("dropped_fields", [])), index=index)
