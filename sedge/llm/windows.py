"""Hashes of word windows, and an exchange that tells chunks of documents what others hold.

Documents are dealt to chunks by a hash of their id and text. A chunk sends each of its distinct keys once,
packed per key bucket, so a passage that stands in a third of all documents costs each chunk one
key. A bucket sees every chunk's keys, answers per chunk, and the answers meet the chunk's
documents again. Both sides are bounded: chunks by bytes of text, buckets by keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(int(_BASE), -1, 2**64))
_MULT = [U(x) for x in (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64-bit values, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Hashes of the words of some documents, laid end to end."""

    hashes: np.ndarray  # per word
    first: np.ndarray  # per document, the place of its first word; one more at the end
    checks: np.ndarray | None = None  # per word, a second and independent hash

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return ends - np.arange(len(self.hashes))

    def starts(self, size: int) -> np.ndarray:
        """Places where a window of `size` words of one document starts."""
        return np.flatnonzero(self.left() >= size)

    def windows(self, size: int, second: bool = False) -> np.ndarray:
        """The hash (or the second one) of the window of `size` words at every place; only those at
        `starts` are whole."""
        h, width, done, at = self.checks if second else self.hashes, 1, None, 0
        rest = size
        while rest:
            if rest & 1:
                part = np.concatenate([h[at:], np.zeros(min(at, len(h)), U)])
                done = part if done is None else done * _MULT[0] + part
                at += width
            rest >>= 1
            if rest:
                h = h * _MULT[1] + np.concatenate([h[width:], np.zeros(min(width, len(h)), U)])
                h = mix(h)
                width *= 2
        return mix(done + U(size))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.arange(1, 257, dtype=U)  # what a byte counts in the first hash
_CHECKS = mix(np.arange(1, 257, dtype=U) * _MULT[3])  # and in the second
_FOLD = np.arange(256)
_FOLD[65:91] += 32
#: Texts are hashed in slices of about so many bytes, cut between words, which bounds the arrays of 8 bytes a byte.
SLICE = 1_000_000


def _slice_end(joined: np.ndarray, at: int) -> int:
    """The first place at or after `at` that holds white space."""
    step = 4096
    while at < len(joined):
        space = _SPACE[joined[at : at + step]]
        if space.any():
            return at + int(space.argmax())
        at, step = at + step, step * 2
    return len(joined)


def read_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, check: bool = False) -> Words:
    """Words (runs without the bytes 20, 09-0D) of whole texts; null and blank texts have none.

    `check` adds the second hash. Beyond the texts themselves, memory follows the words (8 bytes
    each per hash) and one slice.
    """
    raw = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_string())] if len(texts) else []
    sizes = np.array([len(memoryview(r)) if r else 0 for r in raw], dtype=np.int64)
    joined = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
    values = [_BYTES[_FOLD] if lower else _BYTES] + ([_CHECKS[_FOLD] if lower else _CHECKS] if check else [])
    places, hashes, lo = [np.zeros(0, np.int64)], [[np.zeros(0, U)] for _ in values], 0
    while lo < len(joined):
        hi = _slice_end(joined, lo + SLICE)
        some = joined[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[some], [True]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        up, down = _power_tables(len(some) + 1)
        for value, out in zip(values, hashes, strict=True):
            sums = np.zeros(len(some) + 1, U)
            np.cumsum(value[some] * up[: len(some)], out=sums[1:])
            out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _MULT[2]))
        places.append(starts + lo)
        lo = hi
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    hashes = [np.concatenate(x) for x in hashes]
    return Words(hashes[0], np.searchsorted(np.concatenate(places), at), hashes[1] if check else None)


@dataclass
class Scale:
    chunks: int
    buckets: int


def scale_of(docs: DataFrame, chunk_bytes: int = 4_000_000, keys_per_bucket: int = 2_000_000) -> Scale:
    """How many chunks and buckets the texts need. Chunks have one size at any input, so a task's
    memory does not grow; beyond about a terabyte a packed row holds few keys, and the exchange
    costs what a shuffle of one row per key does."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return Scale(max(1, math.ceil(size / chunk_bytes)), max(64, math.ceil(size / 6 / keys_per_bucket)))


def in_chunks(docs: DataFrame, scale: Scale, *columns: str) -> DataFrame:
    """(chunk, doc_id, text, columns). Equal rows fall into one chunk; rows that only share an id,
    or have none, are spread."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale.chunks)).cast("int").alias("chunk"), "doc_id", "text", *columns).repartition("chunk")


SENT = "bucket int, chunk int, keys binary, notes binary"


def packed(chunk: int, keys: np.ndarray, notes: np.ndarray, buckets: int, width: int = 8) -> pa.Table:
    """Sorted distinct keys and a note for each, a row per bucket. Keys are cut to `width` low
    bytes; the bucket holds the high bits."""
    bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
    at = np.searchsorted(bucket, np.arange(buckets + 1).astype(U))
    raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    used = np.flatnonzero(np.diff(at))
    return pa.table(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), chunk), pa.int32()),
            pa.array([raw[at[b] : at[b + 1]].tobytes() for b in used], pa.binary()),
            pa.array([notes[at[b] : at[b + 1]].tobytes() for b in used], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "notes"],
    )


def unpacked(column: pa.ChunkedArray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All keys of packed rows, and the row of each."""
    raw = [memoryview(x.as_buffer()) for x in column]
    counts = np.array([len(x) // width for x in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    if width < 8:
        flat = np.concatenate([flat, np.zeros((len(flat), 8 - width), np.uint8)], axis=1)
    return np.ascontiguousarray(flat).view("<u8").reshape(-1).astype(U), np.repeat(np.arange(len(raw)), counts)


def notes_of(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in column), kind)


def runs_of(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order that sorts keys (and checks among equal keys), the start of each run of equal
    ones in it, and each place's run."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if checks is not None:
        ordered = checks[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def answers(rows: pa.Table, keep: np.ndarray, keys: np.ndarray, row: np.ndarray, notes: np.ndarray) -> pa.Table:
    """The kept keys and notes of a bucket, a row per chunk that sent some."""
    chunks = np.asarray(rows.column("chunk"))
    out = {"chunk": [], "keys": [], "notes": []}
    at = np.flatnonzero(keep)
    cuts = np.searchsorted(row[at], np.arange(len(chunks) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        some = at[cuts[i] : cuts[i + 1]]
        out["chunk"].append(int(chunks[i]))
        out["keys"].append(keys[some].astype("<u8").tobytes())
        out["notes"].append(notes[some].tobytes())
    return pa.table([pa.array(out["chunk"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["notes"], pa.binary())], names=["chunk", "keys", "notes"])


ANSWERS = "chunk int, keys binary, notes binary"
