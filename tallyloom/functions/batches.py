"""Python over batches of long texts: a row at a time, what comes out kept as Arrow.

A batch may hold thousands of texts. As Python objects they, and above all what is made of
them, take many times their size; here only the rows of one piece are Python objects at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: letters of input after which a piece of output is turned into Arrow
PIECE = 1 << 20


def pieces(rows: Iterable[tuple[int, object]], kind: pa.DataType) -> Iterator[pa.Array]:
    """(size, value) -> arrays of the values, each of about ``PIECE`` in size."""
    held, size = [], 0
    for n, value in rows:
        held.append(value)
        size += n
        if size >= PIECE:
            yield pa.array(held, kind)
            held, size = [], 0
    if held:
        yield pa.array(held, kind)


def by_row(made: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``made`` of each row's values; sizes are those of the first column."""
    def rows() -> Iterator[tuple[int, object]]:
        for row in zip(*columns, strict=True):
            values = [x.as_py() for x in row]
            yield len(values[0] or ""), made(*values)

    found = list(pieces(rows(), kind))
    return pa.concat_arrays(found) if found else pa.array([], kind)
