"""What a Python worker keeps between tasks, and giving it back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa

#: Blocks of so many bytes get pages of their own, which go back to the system as soon as they are free.
OWN_PAGES = 1 << 20
#: glibc's M_MMAP_THRESHOLD (fixed value); setting it also stops the allocator from raising it.
_THRESHOLD = -3

#: Dictionaries that operators fill in a worker and use again in its next tasks.
KEPT: list[dict] = []


@cache
def lean() -> None:
    """Let this process return large blocks when they are freed, Arrow's included; without effect where the allocator can't."""
    pa.set_memory_pool(pa.system_memory_pool())
    choose = getattr(ctypes.CDLL(None), "mallopt", None)
    if choose:
        choose(_THRESHOLD, OWN_PAGES)


def trim() -> None:
    """Give free memory back to the system: Arrow's pool, and the allocator's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; before it, what other operators kept is forgotten (unless run uses it), after it memory is given back."""

    def wrapped(batches: Iterator) -> Iterator:
        lean()
        if not keeps:
            for kept in KEPT:
                kept.clear()
        yield from run(batches)
        trim()

    return wrapped
