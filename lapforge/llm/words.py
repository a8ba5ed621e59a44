"""Words, shingles and hashes of Arrow text columns, whole batches at a time.

Both word definitions used here split on ASCII bytes only, so words can be cut on the
UTF-8 bytes: every byte of a longer character is a word byte. Nothing is decoded and no
word becomes a Python object. A word's hash is a polynomial over its lower-cased bytes,
modulo 2^64 and mixed; a shingle's hash is the same over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_BASE, _SHINGLE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def word_table(is_word) -> np.ndarray:
    """Byte to lower-cased byte, or to 0 where `is_word(byte)` is false. Byte 0 is never a word byte."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([lower[b] if b and is_word(b) else 0 for b in range(256)], np.uint8)


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: digits, letters and all beyond ASCII.
ALNUM = word_table(lambda b: b >= 128 or chr(b).isalnum())
# [^\x20\x09-\x0D]+: whatever is no ASCII white space. Byte 0 is a word byte here, so it gets 255,
# which UTF-8 never holds.
SPACED = word_table(lambda b: b != 0x20 and not 9 <= b <= 0x0D)
SPACED[0] = 255


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most `most` bytes (or one row), so memory stays bounded."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets into them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of `h`."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 64), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(mapped bytes, first byte of each word, byte after each word, n + 1 word offsets of the rows)."""
    mapped = table[data]
    inside = mapped != 0
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    ends_flag = inside.copy()
    ends_flag[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_flag[last] = inside[last]
    return mapped, starts, np.flatnonzero(ends_flag) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(hash of every word, n + 1 word offsets of the rows).

    Words are hashed stretch by stretch: the arrays of eight bytes per byte hold PIECE_BYTES (or one
    longer word) at a time, however long a text is.
    """
    mapped, starts, ends, rows = word_spans(data, offsets, table)
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        stop = max(done + 1, int(np.searchsorted(ends, starts[done] + PIECE_BYTES, "right")))
        first, some = starts[done], starts[done:stop] - starts[done]
        piece = mapped[first : ends[stop - 1]]
        place = np.arange(len(piece)) - np.repeat(some, np.diff(np.append(some, len(piece))))
        # Gaps between words count zero; the longest gap may be longer than any word.
        weight = _powers_to(int(place.max()) + 1)[place]
        weight *= piece
        out[done:stop] = mix(np.add.reduceat(weight, some) + (ends[done:stop] - starts[done:stop]).astype(np.uint64))
        done = stop
    return out, rows


def shingles(words: np.ndarray, rows: np.ndarray, size: int):
    """Hashes of `size` consecutive words of each row and their n + 1 row offsets.

    A row of fewer words (but at least one) has its whole sequence as its one shingle.
    """
    counts = np.diff(rows)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(per_row)])
    if not len(words):
        return np.zeros(0, np.uint64), out_rows
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * _SHINGLE_BASE + words[k : k + len(rolled)]
    rolled = mix(rolled)
    row = np.repeat(np.arange(len(counts)), per_row)
    at = rows[:-1][row] + np.arange(len(row)) - out_rows[:-1][row]
    out = np.zeros(len(row), np.uint64)
    whole = counts[row] >= size
    out[whole] = rolled[at[whole]]
    short = at[~whole]
    left = counts[row[~whole]]
    h = left.astype(np.uint64)
    for k in range(size - 1):
        more = k < left
        h[more] = mix(h[more] * _SHINGLE_BASE + words[short[more] + k])
    out[~whole] = h
    return out, out_rows


def distinct_per_row(values: np.ndarray, rows: np.ndarray):
    """Ascending distinct values of each row and their n + 1 offsets."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=n))])


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[rows[1:]] - total[rows[:-1]]
