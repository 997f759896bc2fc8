"""Parts of an Arrow batch that a task works on at once, so that what it holds does not follow the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(sizes: pa.Array, most: int, rows: int = 10_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of at most `most` in all by `sizes` (null: 0) or one row, and of at most `rows` rows."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(sizes, 0)).astype(np.int64))])
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, len(sizes))
        yield lo, hi
        lo = hi


def by_slices(one: Callable, made: pa.DataType, texts: pa.Array, *more: pa.Array, most: int = 1_000_000) -> pa.Array:
    """`one` of each row of `texts` (strings or bytes) and of the columns beside it; about `most` bytes at a time become Python objects."""
    columns = (texts, *more)
    parts = [pa.array([one(*r) for r in zip(*(c.slice(lo, hi - lo).to_pylist() for c in columns), strict=True)], made) for lo, hi in slices(pc.binary_length(texts), most)]
    return pa.concat_arrays(parts) if parts else pa.array([], made)
