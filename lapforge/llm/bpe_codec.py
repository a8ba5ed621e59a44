"""Byte-level BPE: whole texts to token ids and back.

Pre-tokens are cut by the public pattern; each distinct one of a task is merged once by the
segment tree of `bpe.Merges`. Rows are independent, so the work is one narrow pass over the
input: no shuffle, memory bounded by a piece of a batch and a word table of fixed size, and a
lost task is simply run again.

Defined results: a null text is an empty one (no ids, decoded ""); a special string inside a
text is its special id; repeated rows stay repeated; an empty table gives an empty table;
other columns are carried along, except ones named like a result, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapforge.llm.arrow import texts, with_columns
from lapforge.llm.bpe import Merges, WordIds, special_splitter
from lapforge.llm.words import row_sums

# The pattern that cuts texts before merging: a fixed value of the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def words_of(text: str, find, split) -> list:
    """Pre-tokens of a text; a special string becomes a one-tuple."""
    if split is None or split.search(text) is None:
        return find(text)
    out: list = []
    for i, part in enumerate(split.split(text)):
        if i % 2:
            out.append((part,))
        elif part:
            out += find(part)
    return out


def binary_rows(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Bytes and n + 1 offsets as a binary or string array."""
    return pa.Array.from_buffers(
        kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    )


def spelled_rows(merges: Merges, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Texts of the ids of each row; bytes that are no UTF-8 become U+FFFD."""
    begins, sizes = merges.spelled_at[ids], np.diff(merges.spelled_at)[ids]
    shift = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    data = merges.spelled[shift + np.arange(len(shift))]
    offsets = np.concatenate([[0], np.cumsum(row_sums(sizes, rows))])
    out = binary_rows(data, offsets, pa.binary())
    try:
        text = out.cast(pa.string())  # checks the UTF-8
    except pa.ArrowInvalid:
        text = pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())
    return text


def encode(
    df: DataFrame, tokenizer: str, text: str = "text", decoded: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Add `n_tokens` and `ids` (binary: unsigned 32-bit little-endian) of every whole text.

    `tokenizer` is the path of a byte-level vocabulary file, read once on the driver. With
    `decoded`, the text read back from the ids is added under that name in the same pass.
    """
    merges = df.sparkSession.sparkContext.broadcast(Merges(tokenizer))  # the size of the vocabulary
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def prepare():
        table = merges.value
        known = WordIds(table)
        find, split = regex.compile(PATTERN).findall, special_splitter(table.specials)

        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            words: list = []
            ends = [0]
            for t in texts(piece.column(text)):
                words += words_of(t, find, split)
                ends.append(len(words))
            at = known.lookup(words)
            rows = np.concatenate([[0], np.cumsum(row_sums(known.counts[at], np.array(ends)))])
            ids = known.flat(at)
            out = [
                pa.array(np.diff(rows), pa.int64()),
                binary_rows(ids.astype("<u4").view(np.uint8), rows * 4, pa.binary()),
            ]
            return out + [spelled_rows(table, ids, rows)] if decoded else out

        return make

    return with_columns(df, text, fields, prepare, keep)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids (as `encode` gives them) spell; null ids spell nothing."""
    merges = df.sparkSession.sparkContext.broadcast(Merges(tokenizer))

    def prepare():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            each = [np.frombuffer(b or b"", "<u4").astype(np.int64) for b in piece.column(ids).to_pylist()]
            rows = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
            return [spelled_rows(merges.value, np.concatenate(each or [np.zeros(0, np.int64)]), rows)]

        return make

    return with_columns(df, ids, [T.StructField(text, T.StringType())], prepare)
