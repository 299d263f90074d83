"""What a worker process keeps between rows and tasks: one model, and a bounded memory of computed values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Values that one worker remembers: as many since the last turn, and as many of those before it.
REMEMBERED = 250_000


class Memory(dict):
    """Values by key, computed when missing. When it is full, what wasn't asked for since it was last full is forgotten."""

    def __init__(self, compute: Callable, size: int = REMEMBERED):
        self.compute, self.size, self.before = compute, size, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: list[tuple[object, Any]] = []


def kept(key: object, build: Callable[[], Any]) -> Any:
    """The model of key, built when a worker first needs it. Workers outlive a stage, so another key's model goes first; there is never more than one."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, build()))
    return _kept[0][1]


def release() -> None:
    """Called by stages that need no model."""
    _kept.clear()
