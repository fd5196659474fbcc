"""Vectorised text helpers for Arrow functions: byte-balanced blocks, words, safe segments.

All of them work on UTF-8 bytes of one block of rows, so that no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 20_000

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*$%&#")] = True


def blocks(batches: Iterable[pa.RecordBatch], column: str, target: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut by bytes of `column`: a block ends once it has `target` bytes.

    A row is never cut; a text larger than the target is a block of its own with those before it.
    """
    kept: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(lengths):
            ends = np.cumsum(lengths[start:], dtype=np.int64)
            take = min(int(np.searchsorted(ends, target - size, side="left")) + 1, len(ends), max(1, rows - count))
            kept.append(batch.slice(start, take))
            size, count = size + int(ends[take - 1]), count + take
            start += take
            if size >= target or count >= rows:
                yield _joined(kept)
                kept, size, count = [], 0, 0
                # What a block has taken goes back before the next one is read.
                pa.default_memory_pool().release_unused()
    if kept:
        yield _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets into them; a null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and per text its range of words.

    apart marks the 256 byte values that separate; by default words are `[^\\x20\\x09-\\x0D]+`.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~apart[data]
    before = edge[:n].copy()
    before[1:] |= ~solid[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & before)
    return starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of this block's distinct words, and that list."""
    compact = data[~apart[data]]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    coded = binary_array(compact, bounds).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every block and task."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` neighbours; order matters."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + len(out)]
        out = mixed(out)
    return out


def _space_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks of single spaces that stand between two other characters of one text.

    The character before must be printable ASCII or a Latin-1 letter, the one after not white space.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = _SOLID[data]
    letter = np.zeros(n, bool)
    letter[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 0x20) & (solid | letter)[:-2] & (solid | (data == 0xC3))[2:]
    cut &= ~edge[:n] & ~edge[1:]
    return cut


def space_segments(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at each single space, which is dropped: all non-empty segments, each text's range of them."""
    if not len(data):
        return binary_array(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    cut = _space_cuts(data, offsets)
    first = np.append(False, cut[:-1])
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    bounds = np.append(starts, len(data))
    return binary_array(data[~cut], bounds - np.searchsorted(np.flatnonzero(cut), bounds)), np.searchsorted(starts, offsets)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before each single space and between an ASCII letter and a mark of `.,;:!?*$%&#`.

    Nothing is dropped. Returns all non-empty segments and each text's range of them.
    """
    n = len(data)
    if not n:
        return binary_array(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    first = _space_cuts(data, offsets)
    first[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    return binary_array(data, np.append(starts, n)), np.searchsorted(starts, offsets)
