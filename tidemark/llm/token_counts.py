"""Operator 1: token counts of whole texts.

Arrow functions receive rows, cut them into blocks of about equal bytes, split every text at safe
boundaries, encode the distinct segments of the block in one batch with the tokenizer library, and
return lengths only. A boundary is safe where the tokenizer can form no token across it: the model has
no piece in which a space mark follows another character, so the text before a single space and
the text from that space on are encoded independently (`check_boundaries` proves it per model).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import textkit

SPACE_MARK = "▁"
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def load_model(path: str):
    """The model, once per worker process; refuses one for which cutting at spaces is not exact."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_boundaries(model)
    return model


def check_boundaries(model) -> None:
    """Raise if a piece holds a space mark behind another character, or a text gets no space in front."""
    for i in range(model.get_piece_size()):
        if SPACE_MARK in model.id_to_piece(i).lstrip(SPACE_MARK):
            raise ValueError("this model has pieces that reach across spaces")
    if model.encode("a b") != model.encode("a") + model.encode("b"):
        raise ValueError("this model treats the start of a text unlike a space")


def token_lengths(model, texts: pa.Array) -> np.ndarray:
    """Tokens of each text: the distinct segments are encoded in one batch, only lengths are kept."""
    data, offsets = textkit.utf8(texts)
    parts, ranges = textkit.space_segments(data, offsets)
    coded = parts.dictionary_encode()
    encoded = model.encode(coded.dictionary.cast(pa.large_string()).to_pylist(), num_threads=1)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    total = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)], out=total[1:])
    return np.diff(total[ranges])


def count_tokens(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
    block_bytes: int = textkit.BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys come out as often
    as they go in; other columns are neither read nor returned. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for block in textkit.blocks(batches, "text", block_bytes):
            texts = block.column("text")
            tokens = token_lengths(model, texts)
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), size, pa.array(tokens), pa.array(tokens > limit)], schema_names(key))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def schema_names(key: str) -> list[str]:
    return [key, "n_bytes", "n_tokens", "over_limit"]
