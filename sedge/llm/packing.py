"""Best-fit packing by bin completion.

Documents become token ids, long ones are cut into pieces, and pieces are packed into sequences.
What decides a packing is only how many pieces there are of each length, at most `capacity`
numbers however many documents there are. The search runs on that histogram: around the largest
remaining length it enumerates fillings, keeps the undominated ones, prunes by waste, starts from
the best-fit filling as incumbent, and applies a filling as often as the counts allow. Spark then
ranks the pieces within each length and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .sharding import ranked

CAPACITY = 2048
#: Parts of words kept per Python worker; beyond that the memory starts anew.
KEPT_PARTS = 400_000
#: Texts are handled in slices of about so many bytes (or one text, if it is longer).
SLICE_BYTES = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_state: dict = {}


# Classes of bytes. The tokenizer splits lower-case text into runs of letters, single digits and runs
# of other characters, and no token spans white space. ASCII and the two-byte letters named here stay
# as they are under NFC and lower-case to single characters; words with anything else, with an
# apostrophe (contractions) or a "<|" (special tokens) are given to the tokenizer whole.
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
LATIN = [c for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130)]


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, WHOLE, np.uint8)
    kinds[0x21:0x7F] = OTHER
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    kinds[0x30:0x3A] = DIGIT
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kinds[0x27] = WHOLE
    return kinds


_CLASS = _byte_classes()
#: For two bytes: the lower case of the letter of LATIN that they are, as two bytes; 0 for others.
_PAIR = np.zeros((256, 256, 2), np.uint8)
for _c in LATIN:
    _PAIR[0xC0 | _c >> 6, 0x80 | _c & 0x3F] = list(chr(_c).lower().encode())


def _encoder(path: str) -> dict:
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.update(path=path, tokenizer=Tokenizer.from_file(path), known={})
    return _state


def encode_parts(parts: list[str], whole: np.ndarray, path: str) -> list[tuple[int, ...]]:
    """Ids of each of these distinct strings, as the tokenizer gives them; remembered per worker.

    Those that are not `whole` are one piece to the tokenizer's own splitting, so many go in one call.
    """
    s = _encoder(path)
    known, tokenizer = s["known"], s["tokenizer"]
    if len(known) > KEPT_PARTS:
        known.clear()
    new = [(p, w) for p, w in zip(parts, whole.tolist(), strict=True) if p not in known]
    for p in [p for p, w in new if w]:
        known[p] = tuple(tokenizer.encode(p, add_special_tokens=False).ids)
    plain = [p for p, w in new if not w]
    for at in range(0, len(plain), 1000):
        some = plain[at : at + 1000]
        e = tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids, piece = e.ids, np.array(e.word_ids)
        if piece[-1] != len(some) - 1:
            raise ValueError("the tokenizer splits parts of words further")
        cuts = np.searchsorted(piece, np.arange(len(some) + 1)).tolist()
        known.update((p, tuple(ids[a:b])) for p, a, b in zip(some, cuts, cuts[1:], strict=False))
    return [known[p] for p in parts]


def split_parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each part of UTF-8 text that starts and ends with a space, and whether it
    is a whole word. Letters of the other parts become lower case in place."""
    kinds = _CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    pair = _PAIR[raw[lead], raw[lead + 1]]
    lead, pair = lead[pair[:, 0] > 0], pair[pair[:, 0] > 0]
    kinds[lead] = kinds[lead + 1] = LETTER
    kinds[np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))] = WHOLE
    # words with a byte of class WHOLE are one part
    space = kinds == SPACE
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    odd = np.flatnonzero(kinds == WHOLE)
    if len(odd):
        for w in np.unique(np.searchsorted(starts, odd, side="right") - 1):
            kinds[starts[w] : ends[w]] = WHOLE
    plain = kinds[lead] == LETTER
    raw[lead[plain]], raw[lead[plain] + 1] = pair[plain, 0], pair[plain, 1]
    raw += 32 * ((kinds == LETTER) & (raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8)
    new = np.concatenate([[False], (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)])
    first = np.flatnonzero(new & (kinds != SPACE))
    cut = np.flatnonzero(new)
    return first, cut[np.searchsorted(cut, first) + 1], kinds[first] == WHOLE


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids as uint32, each text ended by id 0, and the offsets of the texts. Null: empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    raw = np.frombuffer(bytearray(b" " + b" ".join(x.as_buffer() for x in texts) + b" "), np.uint8)
    first, end, whole = split_parts(raw)
    # the parts end to end, as strings
    size = end - first
    at = np.concatenate([[0], np.cumsum(size)])
    flat = raw[np.repeat(first - at[:-1], size) + np.arange(at[-1])]
    named = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
    codes = np.asarray(named.indices).astype(np.int64)
    odd = np.zeros(len(named.dictionary), bool)
    odd[codes[whole]] = True
    ids = encode_parts(named.dictionary.to_pylist(), odd, path)
    ids.append((0,))
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
    # one more "part", the closing 0, after those of each text
    ends = np.searchsorted(first, 1 + np.cumsum(sizes + 1))
    codes = np.insert(codes, ends, len(ids) - 1)
    per_part = lengths[codes]
    upto = np.concatenate([[0], np.cumsum(per_part)])
    at = np.repeat((np.cumsum(lengths) - lengths)[codes] - upto[:-1], per_part) + np.arange(upto[-1])
    return flat[at], np.concatenate([[0], upto[ends + np.arange(1, len(ends) + 1)]])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("text")) if batch.num_rows else ():
            ids, at = encode_texts(batch.column("text").slice(lo, hi - lo), path)
            doc, piece, start, length, crc = [], [], [], [], []
            raw = memoryview(ids.astype("<u4").tobytes())
            for d, a, b in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, s in enumerate(range(a, b, capacity)):
                    e = min(b, s + capacity)
                    doc.append(d), piece.append(k), start.append(s - a), length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def fillings(gap: int, counts: dict[int, int], most: int = 4, steps: int = 3000) -> list[list[int]]:
    """Undominated fillings of `gap` with available lengths, least waste first.

    The first is best fit (the largest that fits, again and again), the incumbent; a branch goes
    on only if it can waste less than the incumbent, or as little. A filling is dominated if a
    larger available piece could replace one of its pieces, or one more could be added; such
    fillings waste more and are not kept. A step chooses how many pieces of one length are taken,
    so the depth follows the lengths, not the pieces. `steps` (pieces put in, in all) bounds the work for one bin, not
    what is packed.
    """
    have = sorted((k for k, v in counts.items() if v and k <= gap), reverse=True)
    if not have:
        return [[]]
    down = [-k for k in have]
    supply = [0] * (len(have) + 1)  # tokens in the pieces from here on
    for i in range(len(have) - 1, -1, -1):
        supply[i] = supply[i + 1] + have[i] * counts[have[i]]

    def dominated(left: int, taken: list[tuple[int, int]]) -> bool:
        used = dict(taken)
        for k in [0, *used]:
            for j in range(bisect_left(down, -(k + left)), len(have)):
                if have[j] <= k:
                    break
                if counts[have[j]] > used.get(have[j], 0):
                    return True
        return False

    best: list[tuple[int, int, list[tuple[int, int]]]] = []
    most_waste = gap
    spent = 0
    # a frame: [place in `have`, pieces of it taken, room before them]
    path: list[list[int]] = []
    i, left = 0, gap
    while True:
        while True:  # down: as many as fit of each next length
            i = max(i, bisect_left(down, -left))
            if i >= len(have) or not left or left - supply[i] > most_waste:
                break
            n = min(counts[have[i]], left // have[i])
            spent += n
            path.append([i, n, left])
            left -= n * have[i]
            i += 1
        if left <= most_waste:
            taken = [(have[j], n) for j, n, _ in path if n]
            if not dominated(left, taken):
                if not best:
                    most_waste = left
                best.append((left, sum(n for _, n in taken), taken))
                best.sort(key=lambda x: x[:2])
                del best[most:]
        if spent > steps or best and best[0][0] == 0:
            break
        while path and not path[-1][1]:
            path.pop()
        if not path:
            break
        path[-1][1] -= 1  # one piece less of the last length taken
        j, n, before = path[-1]
        i, left = j + 1, before - n * have[j]
    return [[k for k, n in taken for _ in range(n)] for _, _, taken in best]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on the histogram, equal bins together: [(lengths in a sequence, how often)]."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by what is left in a bin
    gaps: list[int] = []  # its keys, in order

    def add(gap: int, lengths: list[int], times: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((lengths, times))

    for k in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[k]
        while left:
            at = bisect_left(gaps, k)
            gap = gaps[at] if at < len(gaps) else capacity
            lengths, times = open_[gap].pop() if at < len(gaps) else ([], left)
            if at < len(gaps) and not open_[gap]:
                del open_[gap], gaps[at]
            # a bin is filled up before the next one, as its gap only gets smaller
            each = min(gap // k, left)
            filled = min(times, left // each)
            add(gap - each * k, lengths + [k] * each, filled)
            if lengths and times > filled:
                add(gap, lengths, times - filled)
            left -= each * filled
    return [(x, n) for gap in gaps for x, n in open_[gap]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = 5_000) -> list[tuple[list[int], int]]:
    """[(lengths in a sequence, how often)], with as few sequences as the search finds.

    Depth first over the fillings around the largest length; a branch ends when its sequences
    plus ceil(tokens left / capacity) reach the best so far, which is best-fit decreasing's at first.
    A descent takes the least wasteful filling at each step; the search ends at the lower bound or
    after `nodes` steps, with the best packing found. Every piece is always packed, and no branch is
    thrown away before.
    """
    total = sum(k * v for k, v in histogram.items())
    large = sum(v for k, v in histogram.items() if 2 * k > capacity)
    bound = max(-(-total // capacity), large)
    best = best_fit(histogram, capacity)
    best_n = sum(n for _, n in best)
    counts = {k: v for k, v in histogram.items() if v}  # what the path leaves; changed in place
    path: list[tuple[list[int], int]] = []

    def put(filling: tuple[list[int], int], sign: int) -> None:
        for k in filling[0]:
            counts[k] = counts.get(k, 0) - sign * filling[1]
            if not counts[k]:
                del counts[k]

    stack = [(0, 0, total, None)]
    spent = 0
    while stack and best_n > bound and spent < nodes:
        depth, used, left, filling = stack.pop()
        while len(path) > depth:
            put(path.pop(), -1)
        while True:
            if filling is not None:
                path.append(filling)
                put(filling, 1)
                used += filling[1]
                left -= sum(filling[0]) * filling[1]
            if used + -(-left // capacity) >= best_n:
                break
            if not counts:
                best, best_n = list(path), used
                break
            if spent >= nodes:
                break
            spent += 1
            top = max(counts)
            counts[top] -= 1
            found = fillings(capacity - top, counts)
            counts[top] += 1
            options = []
            for f in found:
                bin_ = [top, *f]
                options.append((bin_, min(counts[k] // n for k, n in Counter(bin_).items())))
            for o in reversed(options[1:]):
                stack.append((len(path), used, left, o))
            filling = options[0]
    return best


def places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), first rank, first sequence and offset of each run of places."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in bins:
        at = 0
        for k in lengths:
            rows.append((k << 44 | used.get(k, 0), used.get(k, 0), sequence, at))
            used[k] = used.get(k, 0) + times
            at += k
        sequence += times
    cells = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return cells[:, 0], cells[:, 1], cells[:, 2], cells[:, 3]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Documents are cut only when longer than
    `capacity`. Rows with equal ids are separate documents. An empty table gives no rows. Other
    columns of `docs` are not read.
    """
    pieces = staged(docs.select("doc_id", "text").mapInArrow(lambda b: piece_batches(b, tokenizer_path, capacity), PIECES))
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, first, sequence, offset = places(plan(histogram, capacity))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f["rank"].to_numpy()
            i = np.searchsorted(keys, f["length"].to_numpy() << 44 | rank, side="right") - 1
            yield f.drop(columns="rank").assign(sequence_id=sequence[i] + rank - first[i], offset=offset[i])

    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4096)))
    numbered = ranked(spread, "length", "_bucket", ["doc_id", "piece", "ids_crc32"], "rank", "_total")
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(look_up, PIECES + ", sequence_id long, offset long")
