"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window, which form the
index; every rolling window of that size probes it. A repeated window of `size` words contains a
whole reference block wherever it stands first, so each of its occurrences has an anchor. Anchored
places extend to maximal stretches: the windows around an anchor, as far as they repeat. Whether a window
repeats is told by 128 bits of its words, two independent hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .windows import ANSWERS, SENT, U, Words, answers, in_chunks, notes_of, packed, read_words, runs_of, scale_of, unpacked

BLOCK_BYTES = 6  # of a block's hash that are sent; what agrees by chance is compared exactly later
REFERENCE, AGAIN = 1, 2
#: What goes with a window's first hash: the second, and the first document here that has it.
NOTE = np.dtype([("check", "<u8"), ("id", "<i8"), ("hash", "<i8")])
BITS = "chunk int, bucket int, bits binary"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT = "doc_id long, n_words long, n_removed long, text string"


def ordered(docs: pa.Table) -> pa.Table:
    """The chunk's documents by id, a null one first, then by text_hash."""
    return docs.take(pc.sort_indices(docs, [("doc_id", "ascending"), ("text_hash", "ascending")], null_placement="at_start"))


def block_keys(words: Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rolling blocks and their keys, cut to what is sent (bucket and low bytes)."""
    at = words.starts(block)
    return at, words.windows(block)[at]


def send_blocks(chunk: int, docs: pa.Table, block: int, buckets: int) -> pa.Table:
    words = read_words(ordered(docs).column("text"))
    at, keys = block_keys(words, block, buckets)
    place = at - np.repeat(words.first[:-1], np.diff(words.first))[at]
    order, runs, _ = runs_of(keys)
    notes = np.where(place % block == 0, REFERENCE, 0).astype(np.uint8)[order]
    notes = np.bitwise_or.reduceat(notes, runs) if len(runs) else notes
    notes = notes | np.where(np.diff([*runs, len(keys)]) > 1, AGAIN, 0).astype(np.uint8)
    return packed(chunk, keys[order][runs], notes, buckets, BLOCK_BYTES)


def find_anchors(rows: pa.Table) -> pa.Table:
    """Block keys that stand in the index and occur again, for every chunk that has them."""
    keys, row = unpacked(rows.column("keys"), BLOCK_BYTES)
    notes = notes_of(rows.column("notes"), np.uint8)
    order, runs, run = runs_of(keys)
    seen = np.bitwise_or.reduceat(notes[order], runs)
    many = (np.diff([*runs, len(keys)]) > 1) | (seen & AGAIN > 0)
    keep = np.zeros(len(keys), bool)
    keep[order] = (many & (seen & REFERENCE > 0))[run]
    return answers(rows, keep, keys, row, notes)


def stretches(words: Words, anchors: pa.Table, block: int, size: int) -> np.ndarray:
    """Places of the windows that contain an anchor: the windows of the maximal stretches around anchors."""
    at, keys = block_keys(words, block, 0)
    low = U((1 << 8 * BLOCK_BYTES) - 1)
    known = np.unique(unpacked(anchors.column("keys"))[0]) if anchors.num_rows else np.zeros(0, U)
    hit = at[np.isin(keys & low, known)]
    change = np.zeros(len(words.hashes) + 1, np.int32)
    owner = np.repeat(words.first[:-1], np.diff(words.first))
    np.add.at(change, np.maximum(hit - (size - block), owner[hit]), 1)
    np.add.at(change, hit + 1, -1)
    near = np.cumsum(change[:-1]) > 0
    return np.flatnonzero(near & (words.left() >= size))


def stretch_windows(words: Words, anchors: pa.Table, block: int, size: int, key_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the stretches' windows and their two hashes; of the first, `key_bits` count."""
    at = stretches(words, anchors, block, size)
    keys = words.windows(size)[at]
    return at, keys >> U(64 - key_bits) << U(64 - key_bits) if key_bits < 64 else keys, words.windows(size, second=True)[at]


def send_windows(chunk: int, docs: pa.Table, anchors: pa.Table, block: int, size: int, buckets: int, key_bits: int) -> pa.Table:
    """The stretches' windows, each once with the first document that has it in this chunk."""
    docs = ordered(docs)
    words = read_words(docs.column("text"), check=True)
    at, keys, checks = stretch_windows(words, anchors, block, size, key_bits)
    order, runs, _ = runs_of(keys, checks)
    first = order[runs]
    doc = np.searchsorted(words.first, at[first], side="right") - 1
    notes = np.empty(len(first), NOTE)
    notes["check"], notes["id"], notes["hash"] = checks[first], ids_of(docs)[doc], np.asarray(docs.column("text_hash"))[doc]
    return packed(chunk, keys[first], notes, buckets)


def ids_of(docs: pa.Table) -> np.ndarray:
    """Document ids; a null one sorts first."""
    return np.asarray(docs.column("doc_id").fill_null(-(2**63))).astype("<i8")


def find_owners(rows: pa.Table) -> pa.Table:
    """For every chunk, a bit for each window it sent, in that order: whether an earlier document of
    another chunk has it."""
    keys, row = unpacked(rows.column("keys"))
    notes = notes_of(rows.column("notes"), NOTE)
    order, runs, run = runs_of(keys, notes["check"])
    ids, hashes = notes["id"][order], notes["hash"][order]
    later = ids > np.minimum.reduceat(ids, runs)[run]
    least = np.minimum.reduceat(np.where(later, 2**63 - 1, hashes), runs)[run]
    bits = np.empty(len(keys), bool)
    bits[order] = later | (hashes > least)
    cuts = np.searchsorted(row, np.arange(1, rows.num_rows))
    sent = pa.array([np.packbits(x).tobytes() for x in np.split(bits, cuts)], pa.binary())
    return pa.table([rows.column("chunk").combine_chunks(), rows.column("bucket").combine_chunks(), sent], names=["chunk", "bucket", "bits"])


def repeated_words(docs: pa.Table, anchors: pa.Table, later: pa.Table, block: int, size: int, buckets: int, key_bits: int) -> tuple[Words, np.ndarray]:
    """Which words of (ordered) documents stand in a window that starts earlier elsewhere."""
    words = read_words(docs.column("text"), check=True)
    at, keys, checks = stretch_windows(words, anchors, block, size, key_bits)
    order, runs, _ = runs_of(keys, checks)
    first = order[runs]  # stable: the first of a run is the earliest here
    again = np.ones(len(keys), bool)
    sent = np.bincount((((keys[first] >> U(32)) * U(buckets)) >> U(32)).astype(np.int64), minlength=buckets)
    told = later.sort_by("bucket")
    used = np.flatnonzero(sent)
    if not np.array_equal(np.asarray(told.column("bucket")), used):
        raise ValueError("a chunk's windows and their answers do not match")
    bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(told.column("bits"), sent[used].tolist(), strict=True)]
    again[first] = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
    change = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + size, -1)
    return words, np.cumsum(change[:-1]) > 0


def finish(docs: pa.Table, replies: pa.Table, block: int, size: int, buckets: int, digest: bool, key_bits: int) -> pa.Table:
    docs = ordered(docs)
    anchors, later = split_replies(replies)
    words, gone = repeated_words(docs, anchors, later, block, size, buckets, key_bits)
    n_words, n_gone, kept = [], [], []
    for i, text in enumerate(docs.column("text")):
        mask = gone[words.first[i] : words.first[i + 1]]
        parts = bytes(text.cast(pa.large_string()).as_buffer()).split() if text.is_valid else []
        n = int(mask.sum())
        left = b" ".join(parts if not n else compress(parts, (~mask).tolist()))
        n_words.append(len(parts)), n_gone.append(n)
        kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
    return pa.table(
        [docs.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"],
    )


def split_replies(replies: pa.Table) -> tuple[pa.Table, pa.Table]:
    later = replies.column("bits").is_valid()
    return replies.filter(pc.invert(later)), replies.filter(later)


def drop_repeats(docs: DataFrame, size: int = 20, digest: bool = False, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words joined by a space.

    A word goes when a window of `size` words covers it whose word sequence also starts earlier: in
    a document of smaller id, or before in its own. `digest` gives kept_sha256 instead of the text.
    Null and blank texts have no words; texts shorter than `size` lose none; a null id sorts first;
    rows that share an id count in the order of xxhash64 of their texts, so of two equal rows the
    second is the repeat. An empty table gives no rows. Other columns are not read. `key_bits` is
    lowered by tests alone, to make first hashes collide.
    """
    block = size // 2
    scale = scale_of(docs)
    chunks = in_chunks(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), scale, "text_hash")
    n = scale.buckets
    blocks = chunks.groupBy("chunk").applyInArrow(lambda k, t: send_blocks(k[0].as_py(), t, block, n), SENT)
    # written down, so that the blocks' exchange is read once and gone before the windows' begins
    anchors = staged(blocks.groupBy("bucket").applyInArrow(find_anchors, ANSWERS)).select("chunk", "keys")
    windows = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lambda k, t, a: send_windows(k[0].as_py(), t, a, block, size, n, key_bits), SENT)
    later = windows.groupBy("bucket").applyInArrow(find_owners, BITS)
    replies = anchors.unionByName(later, allowMissingColumns=True)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: finish(t, r, block, size, n, digest, key_bits), REMOVED if digest else KEPT)
