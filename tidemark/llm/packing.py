"""Operator 8: sum-of-squares online packing of token ids into fixed windows.

Each task packs the documents of its own scan split, in order, without a shuffle. A document's
ids are cut into full windows first; the rest (shorter than a window) is placed whole into one of
the partially filled windows. With N(h) windows filled to level h, the level h is chosen for
which putting the rest there makes the sum of N(h) squared smallest: N(h) falls by one, N(h + rest)
rises by one, and a full window leaves the count. The counts are an array over levels, so one
choice costs one vectorised pass over at most `window` levels, however many windows are open.

When the split ends, what is still open is closed without padding: the contents are poured into
full windows, cutting where needed, and the last rest is cut into lengths that are powers of two.

The packing of a split depends on the order of its rows only, so a lost task repeats it exactly.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import textkit

WINDOW = 2048
PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")
#: Distinct segments whose ids one worker keeps between blocks; beyond, those met in one block only go.
CACHE_SEGMENTS = 400_000


class SegmentIds:
    """Ids of text segments by the tokenizer library; remembers a bounded number of segments.

    The tokenizer's own pre-split always ends a token before a single space that follows other
    text, and between a letter and a mark, so the ids of a text are those of its segments.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.pool, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int32)  # blocks that held the segment since it was learned or last sifted

    def _sift(self) -> None:
        """Keep the segments met again, if these are at most half of what may be kept; forget the rest."""
        again = np.flatnonzero(self.met > 1)
        if 2 * len(again) > CACHE_SEGMENTS:
            again = np.sort(again[np.argsort(-self.met[again], kind="stable")[: CACHE_SEGMENTS // 2]])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(again)}
        starts, lengths = self.bounds[again], self.bounds[again + 1] - self.bounds[again]
        ends = np.append(0, np.cumsum(lengths))
        self.pool = self.pool[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        self.bounds, self.met = ends, np.zeros(len(again), np.int32)

    def _learn(self, new: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, lengths.sum())])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's range of them."""
        data, offsets = textkit.utf8(texts)
        parts, ranges = textkit.segments(data, offsets)
        if not len(parts):
            return np.empty(0, np.uint32), ranges
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_SEGMENTS or len(self.pool) > 8 * CACHE_SEGMENTS:
            self._sift()
        self._learn([x for x in distinct if x not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.met[number] += 1
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        ends = np.append(0, np.cumsum(lengths))
        return self.pool[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends[ranges]


@lru_cache(maxsize=2)
def segment_ids(path: str) -> SegmentIds:
    return SegmentIds(path)


class Packer:
    """Sum-of-squares packing of one stream of documents.

    `add` takes a document's number and ids; `pieces` holds (document, start, length, crc, window,
    offset) of windows that are closed.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.contents: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        self.next_window = 0
        self.closed: list[tuple[int, list[tuple[int, int, np.ndarray]]]] = []

    def add(self, document: int, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            self._close([(document, start, ids[start : start + self.window])])
        if full < len(ids):
            self._place(document, full, ids[full:])

    def best_level(self, length: int) -> int:
        """Fill level (0: a new window) for which the sum of squared counts grows least.

        A tie goes to the fullest level. Level 0 has no count of its own, nor has the full one.
        """
        room = self.window - length
        counts = self.levels[: room + 1]
        after = self.levels[length : self.window + 1]
        growth = 2 * (after - counts) + 2
        growth[0] = 2 * after[0] + 1
        growth[room] = -2 * counts[room] + 1 if room else 0
        growth[1:][counts[1:] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(growth[::-1]))

    def _place(self, document: int, start: int, ids: np.ndarray) -> None:
        level = self.best_level(len(ids))
        if level:
            number = self.open[level].pop()
            self.levels[level] -= 1
        else:
            number = self.next_window
            self.next_window += 1
            self.contents[number] = []
        self.contents[number].append((document, start, ids))
        level += len(ids)
        if level == self.window:
            self.closed.append((number, self.contents.pop(number)))
        else:
            self.open.setdefault(level, []).append(number)
            self.levels[level] += 1

    def _close(self, content: list[tuple[int, int, np.ndarray]]) -> None:
        self.closed.append((self.next_window, content))
        self.next_window += 1

    def finish(self) -> None:
        """Pour what is open into full windows; the rest into lengths that are powers of two."""
        pieces = [piece for number in sorted(self.contents) for piece in self.contents[number]]
        self.contents.clear()
        self.open.clear()
        self.levels[:] = 0
        left = sum(len(ids) for _, _, ids in pieces)
        pieces.reverse()
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            content = []
            while room:
                document, start, ids = pieces.pop()
                content.append((document, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((document, start + room, ids[room:]))
                room -= min(room, len(ids))
            self._close(content)

    def take(self) -> list[tuple[int, list[tuple[int, int, np.ndarray]]]]:
        closed, self.closed = self.closed, []
        return closed


def pack(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1,
    block_bytes: int = textkit.BLOCK_BYTES, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A document is its token ids, then end_id; a null or empty text is end_id alone. with_ids adds
    the piece's ids (little-endian unsigned 32 bits). sequence_id is unique in the table: the
    task's number in the upper bits. sequence_tokens is the window's filled length. Repeated rows
    are packed as often as they come, null keys are kept, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = segment_ids(tokenizer_path), Packer(window)
        base = TaskContext.get().partitionId() << 40
        keys: dict[int, tuple] = {}  # of documents with pieces that are not out yet: key, tokens, ids left
        count = 0

        def out() -> pa.RecordBatch:
            rows = []
            for number, content in packer.take():
                offset, filled = 0, sum(len(ids) for _, _, ids in content)
                for document, start, ids in content:
                    name, tokens, left = keys.pop(document)
                    if left > len(ids):
                        keys[document] = (name, tokens, left - len(ids))
                    raw = ids.astype("<u4").tobytes()
                    rows.append((name, start, len(ids), zlib.crc32(raw), tokens, base + number, offset, filled, *([raw] if with_ids else [])))
                    offset += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)

        fields = None
        for block in textkit.blocks(batches, "text", block_bytes):
            if fields is None:
                fields = pa.schema([(key, block.schema.field("key").type)] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")] + ([("ids", pa.binary())] if with_ids else []))
            ids, ranges = ids_of.of(block.column("text"))
            for name, start, stop in zip(block.column("key").to_pylist(), ranges[:-1], ranges[1:], strict=True):
                own = np.append(ids[start:stop], np.uint32(end_id))
                keys[count] = (name, len(own), len(own))
                packer.add(count, own)
                count += 1
            yield out()
        if fields is not None:
            packer.finish()
            yield out()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"`{key}` {kind}, {PIECES}" + (", ids binary" if with_ids else ""))
