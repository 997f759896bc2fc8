"""Words of letters and digits, and batches of a bounded size, for the operators that compare texts word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII letters in lower case, digits and whatever is no ASCII stay; all else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that are looked at together, at least one whole text.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches, in batches of at most about SLICE bytes of `column`."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
            cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield batch.slice(lo, hi - lo)


def plain(texts: pa.Array) -> pa.Array:
    """The texts with words in lower case and spaces for all else; null is empty. Bytes keep their places."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = bytes(memoryview(whole.buffers()[2])[at[0] : at[-1]]) if whole.buffers()[2] is not None else b""
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw.translate(FOLD)))


def words_in(text: pa.Scalar) -> list[str]:
    """The words of one text of `plain`; other white space than the blank is part of words."""
    return [w for w in text.as_py().split(" ") if w]
