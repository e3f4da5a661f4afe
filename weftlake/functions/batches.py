"""Arrow batches within Python workers: what is made of a batch is bounded by its bytes, not by its rows."""

from __future__ import annotations

from collections.abc import Iterator

#: Rows and bytes of a piece: what Python makes of a page, its tree and its texts, takes many times the page's bytes.
ROWS, BYTES = 256, 2_000_000


def pieces(batches: Iterator, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """The batches cut into pieces of so many rows and about so many bytes at most (a row is never cut), without copies.

    A worker gives free memory back at the end.
    """
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    give_back()


def give_back() -> None:
    """Free memory to the system: idle workers stay, with all that their last task took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass
