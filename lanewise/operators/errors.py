"""Conditions raised by the engine, and sentinels that bounded waits return."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, **fields):
        super().__init__(message)
        self.__dict__.update(fields)


class SubmitTimeout(EngineError): ...
class SlotsExhausted(EngineError): ...
class Stopped(EngineError): ...
class Cancelled(EngineError): ...
class WorkerDied(EngineError): ...
class TaskLost(EngineError): ...
class NotPortable(EngineError): ...
class RemoteError(EngineError): ...
class TemplateMismatch(EngineError): ...


class Sentinel:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return f"<{self.name}>"


TIMEOUT, CLOSED, FULL, PEER_GONE = map(Sentinel, ("timeout", "closed", "full", "peer_gone"))


def is_sentinel(x: object) -> bool:
    return any(x is s for s in (TIMEOUT, CLOSED, FULL, PEER_GONE))


def is_remote_error(x: object) -> bool:
    return isinstance(x, RemoteError)
