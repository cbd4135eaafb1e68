"""Texts as Arrow buffers, cut at ASCII white space.

The Python stages of this subpackage work on whole Arrow batches.  A batch is
cut into *pieces* (maximal runs without ASCII white space) with a few array
operations on its byte buffer, and the pieces are dictionary-encoded, so that
per-piece work (hashing, sub-word encoding) is done once per distinct piece.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Text bytes worked on at once; a longer single text is worked on whole.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """``batch`` in consecutive row ranges of at most about ``most`` text bytes."""
    if not batch.num_rows:
        return
    ends = cut_buffer(batch.column(column))[1]
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, ends[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def cut_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text boundaries in them); NULL is empty."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[
        texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker is kept for later tasks,
    and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


@dataclass
class Pieces:
    data: np.ndarray        # bytes of all texts
    bounds: np.ndarray      # text boundaries in data
    first: np.ndarray       # piece number at each text boundary
    start: np.ndarray       # first byte of each piece, in data
    length: np.ndarray      # bytes of each piece
    index: np.ndarray       # distinct piece of each piece
    words: pa.Array         # distinct pieces


def cut_pieces(texts: pa.Array, lower: bool = False) -> Pieces:
    data, bounds = cut_buffer(texts)
    if lower:
        data = _LOWER[data]
    word = ~SPACE[data]
    begins = word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    packed = data[word]
    before = np.concatenate([[0], np.cumsum(word, dtype=np.int32 if len(word) < 2 ** 31 else np.int64)])  # non-space bytes before each byte
    offsets = np.append(before[start], len(packed))
    if len(packed) < 2 ** 31 - 1:
        flat = pa.Array.from_buffers(pa.string(), len(start), [
            None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(packed)])
    else:
        flat = pa.Array.from_buffers(pa.large_string(), len(start), [
            None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(packed)])
    coded = flat.dictionary_encode()
    return Pieces(data, bounds, np.searchsorted(start, bounds), start, np.diff(offsets),
                  coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
