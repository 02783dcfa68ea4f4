"""What a Python worker keeps between tasks.

Workers are reused: without care, each operator of a pipeline would leave its
tables in them. One owner holds a cache at a time; when another claims it, the
tables before are dropped and their memory goes back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

_owner: str | None = None
_held: dict = {}


def _libc():
    with contextlib.suppress(OSError):  # glibc only
        return ctypes.CDLL("libc.so.6")
    return None


def release() -> None:
    """Give freed memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):
        _libc().malloc_trim(0)


def tidy(run):
    """The function of a ``mapInArrow``, with its memory given back as a task
    ends: idle workers stay, and the next stage's executors need it."""

    def wrapped(stream):
        try:
            yield from run(stream)
        finally:
            release()

    return wrapped


def claim(owner: str) -> dict:
    """The cache of this owner; those of all others are dropped."""
    global _owner, _held
    if owner != _owner:
        had = bool(_held)
        _owner, _held = owner, {}
        if had:
            release()
    return _held
