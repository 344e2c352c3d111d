"""What a Python worker keeps between tasks.

Workers outlive a task and serve other operators next, so what they hold adds up in an
executor.  A task drops the tables of other operators when it starts, and gives free
memory back to the system when it ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_HELD: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it decides by itself
        pass


def tidy(owner: str, forget: Callable[[], None] | None = None):
    """Make a function over Arrow batches one that keeps no memory but its owner's tables.

    ``forget`` drops what ``owner`` keeps for its own next task; it is called once a task
    of another owner begins.
    """

    def around(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @wraps(run)
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for other in [x for x in _HELD if x != owner]:
                _HELD.pop(other)()
            if forget:
                _HELD[owner] = forget
            yield from run(batches)
            _give_back()

        return task

    return around
