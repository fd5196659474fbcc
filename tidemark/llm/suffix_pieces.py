"""Operator 9: SentencePiece encoding and decoding by suffix-array matching.

Each block of texts is cut at single spaces, where no piece can reach across. Its distinct new
segments are laid end to end and indexed by a suffix array, sorted as deep as the longest piece.
Every piece of the model is binary-searched for its range of suffixes; each occurrence is an edge
(position, length, piece). The edges are laid out by position, and relaxed: a segment starts as single
characters, and the best-scored edge that covers exactly two neighbouring symbols (the leftmost of
equals) joins them, until none is left. All segments of one length are relaxed together; a long
segment by a heap. This is the model's own rule, so the ids are those of its library.

Characters without a piece become their UTF-8 bytes' pieces. Decoding turns ids into bytes, marks
into spaces, and drops the space that encoding puts in front.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import textkit
from tidemark.llm.token_counts import SPACE_MARK, load_model

#: Characters that one suffix array covers.
INDEX_CHARS = 1 << 20
#: Segments longer than this are relaxed by a heap, one at a time.
LONG_SEGMENT = 48
#: Distinct segments whose ids one worker keeps between blocks.
CACHE_SEGMENTS = 400_000


class Pieces:
    """The pieces of a BPE model with byte fallback, ready for matching."""

    def __init__(self, path: str):
        model = load_model(path)
        count = model.get_piece_size()
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = np.array([model.get_score(i) for i in range(count)], np.float32)
        text = {i: model.id_to_piece(i) for i in plain}
        self.longest = max(len(p) for p in text.values())
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.ids = np.array(plain, np.int32)
        self.lengths = np.array([len(text[i]) for i in plain], np.int64)
        self.points = np.zeros((len(plain), self.longest), np.uint32)
        for row, i in enumerate(plain):
            self.points[row, : self.lengths[row]] = np.frombuffer(text[i].encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(self.points)
        raw = [text[i].replace(SPACE_MARK, " ").encode() if i in text else b"" for i in range(count)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.append(0, np.cumsum([len(x) for x in raw]))

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edge table of a text (code points, 0 between segments): [position, length] -> piece id or -1.

        Also each position's character rank; characters that no piece has share the rank of 0.
        """
        alphabet = self.alphabet
        rank = np.searchsorted(alphabet, text)
        rank[rank == len(alphabet)] = 0
        rank[alphabet[rank] != text] = 0
        used, rank = np.unique(np.append(0, rank), return_inverse=True)
        rank = rank[1:]
        # Pieces in ranks of this text's alphabet; pieces with other characters do not occur.
        known = np.searchsorted(alphabet[used], self.points)
        known[known == len(used)] = 0
        possible = (alphabet[used][known] == self.points).all(axis=1)
        pieces, lengths, ids = known[possible], self.lengths[possible], self.ids[possible]
        depth = self.longest
        suffixes = np.lib.stride_tricks.sliding_window_view(np.append(rank, np.zeros(depth)).astype(">u2"), depth)[: len(rank)]
        order = _suffix_order(rank, depth)
        table = np.full((len(rank), depth + 1), -1, np.int32)
        width = 2 * depth
        sorted_suffixes = np.ascontiguousarray(suffixes[order]).view(f"S{width}").ravel()
        low = np.where(np.arange(depth)[None, :] < lengths[:, None], pieces, 0).astype(">u2")
        high = np.where(np.arange(depth)[None, :] < lengths[:, None], pieces, 0xFFFF).astype(">u2")
        start = np.searchsorted(sorted_suffixes, np.ascontiguousarray(low).view(f"S{width}").ravel(), "left")
        stop = np.searchsorted(sorted_suffixes, np.ascontiguousarray(high).view(f"S{width}").ravel(), "right")
        found = np.maximum(stop - start, 0)
        ends = np.cumsum(found)
        at = order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - found), found)]
        table[at, np.repeat(lengths, found)] = np.repeat(ids, found)
        return table, rank


def _suffix_order(rank: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared by their first `depth` ranks."""
    padded = np.append(rank, np.zeros(depth + 4)).astype(np.uint64)
    n = len(rank)
    key = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
    order = np.argsort(key[:n], kind="stable")
    group = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
    for start in range(4, depth, 4):
        tied = np.append(False, group[1:] == group[:-1])
        tied[:-1] |= tied[1:].copy()
        places = np.flatnonzero(tied)
        if not len(places):
            break
        own = order[places]
        deeper = key[np.minimum(own + start, len(key) - 1)]
        inner = np.lexsort((deeper, group[places]))
        order[places] = own[inner]
        # New groups: ties that this level has told apart.
        changed = np.append(False, (group[places][1:] != group[places][:-1]) | (deeper[inner][1:] != deeper[inner][:-1]))
        step = np.zeros(n, np.int64)
        step[1:] = group[1:] != group[:-1]
        step[places] |= changed
        group = np.cumsum(step)
    return order


def _relax_rows(table: np.ndarray, scores: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol ends of segments of one length: (is a symbol start, its length), each n x length."""
    n, depth = len(base), table.shape[1] - 1
    rows = np.arange(n)
    size = np.zeros((n, length), np.int64)
    size[:] = 1
    after = np.tile(np.arange(1, length + 1), (n, 1))
    before = np.tile(np.arange(-1, length - 1), (n, 1))
    value = np.full((n, length), -np.inf, np.float32)
    if length > 1 and depth >= 2:
        pair = table[base[:, None] + np.arange(length - 1), 2]
        value[:, :-1] = np.where(pair >= 0, scores[pair], -np.inf)
    alive = np.ones((n, length), bool)

    def rescore(row: np.ndarray, left: np.ndarray) -> None:
        right = after[row, left]
        ok = right < length
        total = size[row, left] + size[row, np.where(ok, right, 0)]
        ok &= total <= depth
        piece = np.where(ok, table[base[row] + left, np.where(ok, total, 0)], -1)
        value[row, left] = np.where(piece >= 0, scores[piece], -np.inf)

    while len(rows):
        best = np.argmax(value[rows], axis=1)
        go = value[rows, best] > -np.inf
        rows, best = rows[go], best[go]
        if not len(rows):
            break
        right = after[rows, best]
        size[rows, best] += size[rows, right]
        alive[rows, right] = False
        value[rows, right] = -np.inf
        following = after[rows, right]
        after[rows, best] = following
        inner = following < length
        before[rows[inner], following[inner]] = best[inner]
        rescore(rows, best)
        previous = before[rows, best]
        has = previous >= 0
        rescore(rows[has], previous[has])
    return alive, size


def _relax_long(table: np.ndarray, scores: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long segment, by a heap of edges."""
    depth = table.shape[1] - 1
    size, alive = np.ones(length, np.int64), np.ones(length, bool)
    after, before = list(range(1, length + 1)), list(range(-1, length - 1))
    heap: list[tuple[float, int, int]] = []

    def push(left: int) -> None:
        right = after[left]
        if right < length and (total := int(size[left] + size[right])) <= depth and (piece := table[base + left, total]) >= 0:
            heapq.heappush(heap, (-float(scores[piece]), left, total))

    for i in range(length - 1):
        push(i)
    while heap:
        _, left, total = heapq.heappop(heap)
        if not alive[left] or (right := after[left]) >= length or size[left] + size[right] != total:
            continue
        size[left], alive[right] = total, False
        after[left] = after[right]
        if after[left] < length:
            before[after[left]] = left
        push(left)
        if before[left] >= 0:
            push(before[left])
    return alive, size


def encode_segments(pieces: Pieces, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments (marks in place of spaces, one in front already), and how many each has."""
    ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    start = 0
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    while start < len(segments):
        ends = np.cumsum(lengths[start:] + 1)
        stop = start + max(1, int(np.searchsorted(ends, INDEX_CHARS, "right")))
        found, own = _encode_part(pieces, segments[start:stop], lengths[start:stop])
        ids.append(found)
        counts.append(own)
        start = stop
    return np.concatenate(ids), np.concatenate(counts)


def _encode_part(pieces: Pieces, segments: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum(lengths + 1) - (lengths + 1)
    # A NUL inside a segment has no piece either: it is a character without rank.
    table, _ = pieces.edges(text)
    alive, size = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    for length in np.unique(lengths[lengths <= LONG_SEGMENT]):
        own = base[lengths == length]
        for at in range(0, len(own), 65_536):
            part = own[at : at + 65_536]
            a, s = _relax_rows(table, pieces.scores, part, int(length))
            places = part[:, None] + np.arange(length)
            alive[places], size[places] = a, s
    for i in np.flatnonzero(lengths > LONG_SEGMENT):
        b, n = int(base[i]), int(lengths[i])
        alive[b : b + n], size[b : b + n] = _relax_long(table, pieces.scores, b, n)
    starts = np.flatnonzero(alive)
    ids = table[starts, size[starts]]
    missing = np.flatnonzero(ids < 0)
    counts = np.ones(len(starts), np.int64)
    raw = {int(k): chr(text[starts[k]]).encode("utf-8", "replace") for k in missing}
    for k, bytes_ in raw.items():
        counts[k] = len(bytes_)
    out = np.repeat(ids, counts)
    first = np.cumsum(counts) - counts
    for k, bytes_ in raw.items():
        out[first[k] : first[k] + len(bytes_)] = pieces.byte_ids[list(bytes_)]
    bounds = np.append(first, len(out))[np.searchsorted(starts, np.append(base, len(text)))]
    return out, np.diff(bounds)


class Encoder:
    """Encodes blocks of texts; remembers a bounded number of segments."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's range of them."""
        data, offsets = textkit.utf8(texts)
        parts, ranges = textkit.space_segments(data, offsets)
        if not len(parts):
            return np.empty(0, np.int32), ranges
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_SEGMENTS or len(self.pool) > 8 * CACHE_SEGMENTS:
            self._forget()
        new = [x for x in distinct if x not in self.known]
        ids, counts = encode_segments(self.pieces, [SPACE_MARK + x.decode().replace(" ", SPACE_MARK) for x in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pool = np.concatenate([self.pool, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        ends = np.append(0, np.cumsum(lengths))
        return self.pool[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends[ranges]

    def decode(self, ids: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts end to end, and their offsets; the space in front is dropped."""
        pieces = self.pieces
        starts = pieces.raw_at[ids]
        lengths = pieces.raw_at[ids + 1] - starts
        ends = np.append(0, np.cumsum(lengths))
        data = pieces.raw[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        offsets = ends[ranges]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        front = offsets[:-1][filled]
        dropped = front[data[front] == 0x20]
        keep = np.ones(len(data), bool)
        keep[dropped] = False
        return data[keep], offsets - np.searchsorted(dropped, offsets)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = textkit.BLOCK_BYTES) -> DataFrame:
    """One row per row: key, ids array<int>. A null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for block in textkit.blocks(batches, "text", block_bytes):
            ids, ranges = own.encode(block.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column("key"), lists], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: key, text. Null or empty ids give an empty text; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            lists = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, offsets = own.decode(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths)))
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trips(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = textkit.BLOCK_BYTES) -> DataFrame:
    """One row per row: key, n_ids, ids_crc32 (little-endian unsigned 32 bits), same (decoded = text).

    A null text counts as empty. `same` is false only for texts that hold the model's space mark
    itself. Repeated rows and null keys come out as they go in; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for block in textkit.blocks(batches, "text", block_bytes):
            texts = block.column("text")
            ids, ranges = own.encode(texts)
            back, at = own.decode(ids, ranges)
            data, offsets = textkit.utf8(texts)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
            same = textkit.binary_array(back, at).cast(pa.large_binary())
            same = pc.equal(same, textkit.binary_array(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(np.diff(ranges)), pa.array(crc, pa.int64()), same], [key, "n_ids", "ids_crc32", "same"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n_ids long, ids_crc32 long, same boolean")
