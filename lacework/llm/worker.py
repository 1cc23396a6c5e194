"""What a Python worker remembers between the tasks of one operator, in a budget of bytes.

Spark hands one worker process from task to task and from operator to operator. Tables of words and vocabularies make
the tasks of one operator faster; a task of another operator makes the worker forget them all, and what is freed goes
back to the system at the end of every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa

#: Bytes that the tables of one operator may take in a worker, about.
BUDGET = 48 << 20
#: Bytes of a table's entry besides its key and value, about.
ENTRY = 100

_forget: list[Callable[[], None]] = []
_owner: str | None = None


class Remembered(dict):
    """A table that empties itself when its entries take more than `most` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0
        _forget.append(self.empty)

    def empty(self) -> None:
        self.clear()
        self.held = 0

    def keep(self, key, value, size: int) -> None:
        """size: of key and value together."""
        self.held += size + ENTRY
        if self.held > self.most:
            self.empty()
        self[key] = value


def forgets(what: Callable[[], None]) -> None:
    """Has `what` called when the worker turns to another operator."""
    _forget.append(what)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _task(owner: str, run: Callable[[Iterator], Iterator], batches: Iterator) -> Iterator:
    global _owner
    if owner != _owner:
        for forget in _forget:
            forget()
        trim()
        _owner = owner
    try:
        yield from run(batches)
    finally:
        trim()


def tasks_of(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, as the function of the tasks of one operator."""
    return partial(_task, owner, run)
