"""Memory of Python workers, which Spark uses for one operator's tasks after another's.

Freed memory stays with a process: Arrow's pool keeps it, and malloc keeps all that lies below something in use. So each
task hands back what it freed, and what one kind of task leaves for the next of its kind goes when another kind begins.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa

#: Rows of an Arrow column that are Python objects at a time.
ROWS = 64
#: glibc's, which other C libraries lack.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What tasks of this process left for the next one of their kind: (key, value) by kind.
_left: dict[str, tuple[Hashable, object]] = {}


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def left(kind: str, key: Hashable, make: Callable):
    """``make()``, made once for tasks of a kind that follow each other in this process with the same key."""
    if kind not in _left or _left[kind][0] != key:
        _left.pop(kind, None)
        _left[kind] = key, make()
    return _left[kind][1]


def begin(kind: str | None) -> None:
    """Let go of what other kinds of task left."""
    if others := [k for k in _left if k != kind]:
        for k in others:
            del _left[k]
        gc.collect()  # an encoder refers to itself
        give_back()


def task(function: Callable[[Iterator], Iterator], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that begins without what other kinds of task left, and gives back what it freed.

    It is pickled by value, with the globals that it names, so it calls what holds the process's own state.
    """

    @wraps(function)
    def run(batches):
        begin(kind)
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column, null as empty, without all of them as Python objects at once."""
    for i in range(0, len(column), ROWS):
        for text in column.slice(i, ROWS).to_pylist():
            yield text or ""
