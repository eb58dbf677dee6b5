"""Vectorised word and shingle hashing shared by the text operators.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased, so the
same word always has the same 64-bit hash whatever stands around it.  Texts are hashed straight
out of an Arrow string column's buffers, in segments of bounded size cut at white space.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes hashed at once, unless a single word is longer
_BASE = 0x9E3779B97F4A7C15 | 1
_MUL = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
#: Values of bytes where A-Z are not taken as a-z.
PLAIN = np.arange(256, dtype=np.uint64) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words that are runs of letters and digits: every other ASCII byte separates.
MARKS = np.zeros(256, dtype=bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            if size <= 4 * SEGMENT:
                _powers[name] = table
            else:
                _powers[f"big-{name}"] = table
        if size > 4 * SEGMENT:
            return _powers.pop("big-up"), _powers.pop("big-down")
    return _powers["up"], _powers["down"]


def _hash_segment(data: np.ndarray, gaps: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes of the words of one segment, which starts and ends at word boundaries."""
    return _located(data, gaps)[0]


def _located(data: np.ndarray, gaps: np.ndarray = _SPACE, values: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~gaps[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            space = np.flatnonzero(_SPACE[data[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:  # one word longer than a segment: go on to its end
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(data: np.ndarray, gaps: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hashes of the words of one text given as UTF-8 bytes, in text order."""
    if len(data) <= SEGMENT:
        return _hash_segment(data, gaps)
    return np.concatenate([np.empty(0, np.uint64)] + [_hash_segment(data[a:b], gaps) for a, b in _cuts(data)])


def located_words(data: np.ndarray, values: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with the byte offsets at which each word starts and ends."""
    parts = [(h, s + a, e + a) for a, b in _cuts(data) for h, s, e in [_located(data[a:b], _SPACE, values)]]
    if not parts:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive words; empty when there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    total = np.full(count, np.uint64(n))
    for i in range(n):
        total = total * _MUL + words[i : i + count]
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingle hashes; fewer words than n count as one shingle, none as none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(words, min(n, len(words))))


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield raw[:0] if null is not None and null[i] else raw[at[i] : at[i + 1]]


def text_groups(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch whose texts hold at most ``limit`` bytes (single texts may be longer), with the texts' bytes."""
    texts = list(text_bytes(batch.column(column)))
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > limit:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@functools.cache
def _trim() -> Callable[[int], object]:
    """The C library's way to hand free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: None


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of mapInArrow that hands its memory back when its task ends: workers live on and are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run
