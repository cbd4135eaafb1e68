"""Sub-word ids of whole texts with the tokenizers library.

The vocabulary files used here never join text across white space: their
normaliser turns a white-space run into one space and their pre-tokeniser
matches no space, so the ids of a text are the ids of its white-space-free
pieces, one after the other.  :class:`TextEncoder` uses that: it encodes each
distinct piece of a batch once and assembles the ids (and, if asked, the
character span of every id) of the whole texts with array operations.
``check_splits`` makes the encoder compare itself with the library on given
texts.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabrisk.llm.pieces import Pieces, cut_buffer, cut_pieces, ranges

#: Distinct pieces remembered between batches of one Python worker, and their longest.
REMEMBER = 400_000
REMEMBER_BYTES = 64
#: Share of a batch's pieces that a full memory must know to be kept as it is.
KNOWN = 0.5
#: Pieces handed to the library as one string.
JOINED = 256
#: Such strings encoded by one call; their encodings are large.
AT_ONCE = 16


class _Grown:
    """An array that is appended to, in room that doubles."""

    def __init__(self, dtype, *shape: int):
        self.room, self.size = np.zeros((1024, *shape), dtype), 0

    def append(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            room = np.zeros((max(size, 2 * len(self.room)), *self.room.shape[1:]), self.room.dtype)
            room[:self.size] = self.room[:self.size]
            self.room = room
        self.room[self.size:size] = more
        self.size = size

    def __getitem__(self, at) -> np.ndarray:
        return self.room[:self.size][at]


class _Memory:
    """Pieces seen so far with their ids (and spans), found by hash and compared
    byte by byte."""

    def __init__(self, id_type, spans: bool):
        self.hashes = np.zeros(0, np.uint64)         # ascending
        self.number = np.zeros(0, np.int32)          # piece of each hash
        self.data, self.start = _Grown(np.uint8), _Grown(np.int32)  # at most REMEMBER * REMEMBER_BYTES
        self.ids, self.first = _Grown(id_type), _Grown(np.int32)
        self.length, self.count = _Grown(np.int32), _Grown(np.int32)
        self.spans = _Grown(np.int32, 2) if spans else None

    def find(self, hashes, data, start, length) -> np.ndarray:
        """The number of each piece, -1 if it is not remembered."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = self.number[at].astype(np.int64)
        alike = np.flatnonzero((self.hashes[at] == hashes) & (self.length[number] == length))
        mine, own = data[ranges(start[alike], length[alike])], self.data[ranges(self.start[number[alike]], length[alike])]
        wrong = np.concatenate([[0], np.cumsum(mine != own)])
        ends = np.cumsum(length[alike])
        out = np.full(len(hashes), -1)
        good = alike[wrong[ends] == wrong[ends - length[alike]]]
        out[good] = number[good]
        return out

    def add(self, hashes, data, start, length, ids, count, spans) -> None:
        """Remember new pieces; ``ids`` and ``count`` are theirs, in their order."""
        own, at = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, own)
        if len(self.hashes):  # of pieces of one hash the first stays
            fresh = self.hashes[np.minimum(place, len(self.hashes) - 1)] != own
            own, at, place = own[fresh], at[fresh], place[fresh]
        known = self.start.size
        self.hashes = np.insert(self.hashes, place, own)
        self.number = np.insert(self.number, place, np.arange(known, known + len(at), dtype=np.int32))
        where = ranges(np.cumsum(count)[at] - count[at], count[at])
        self.start.append(self.data.size + np.cumsum(length[at]) - length[at])
        self.first.append(self.ids.size + np.cumsum(count[at]) - count[at])
        self.length.append(length[at])
        self.count.append(count[at])
        self.data.append(data[ranges(start[at], length[at])])
        self.ids.append(ids[where])
        if self.spans is not None:
            self.spans.append(spans[where])


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece (of its bytes and their places)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    h = np.add.reduceat((data[ranges(start, length)].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFF], ends - length)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class TextEncoder:
    """Ids of whole texts; ``special_as_text`` reads the vocabulary's special
    strings in a text as ordinary text (the library's default does not), and
    ``spans`` keeps the character spans of ids too."""

    def __init__(self, path: str, special_as_text: bool = False, remember: int = REMEMBER, spans: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.remember, self.with_spans = remember, spans
        self.id_type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.memory = _Memory(self.id_type, spans)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, spans inside the word, ids per word) of distinct words."""
        if not len(words):
            return np.zeros(0, self.id_type), np.zeros((0, 2), np.int32), np.zeros(0, np.int64)
        cuts = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, spans, counts = [], [], []
        encoded = (e for i in range(0, len(joined), AT_ONCE)
                   for e in self.tokenizer.encode_batch(joined[i:i + AT_ONCE], add_special_tokens=False))
        for a, b, e in zip(cuts, cuts[1:], encoded):
            starts = np.cumsum(lengths[a:b] + 1) - lengths[a:b] - 1
            at = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
            owner = np.searchsorted(starts, at[:, 0], "right") - 1
            ids.append(np.array(e.ids, self.id_type))
            if self.with_spans:
                spans.append((at - starts[owner, None]).astype(np.int32))
            counts.append(np.bincount(owner, minlength=b - a))
        return np.concatenate(ids), np.concatenate(spans) if spans else np.zeros((0, 2), np.int32), np.concatenate(counts)

    def _pool(self, pieces: Pieces):
        """(ids, spans, first id, number of ids) of each distinct piece of a batch;
        what is new to the memory is encoded and, short pieces, remembered."""
        words = pieces.words.cast(pa.string())
        data, bounds = cut_buffer(words)
        start, length = bounds[:-1], np.diff(bounds)
        hashes = _hashes(data, start, length)
        number = self.memory.find(hashes, data, start, length)
        new = np.flatnonzero(number < 0)
        ids, spans, count = self._encode_words(words.take(pa.array(new)))
        short = length[new] <= REMEMBER_BYTES
        memory, keeps = self.memory, self.memory.start.size + int(short.sum()) <= self.remember
        if not keeps and (number[pieces.index] >= 0).mean() < KNOWN:  # full of what is not met any more
            self.memory, keeps = _Memory(self.id_type, self.with_spans), int(short.sum()) <= self.remember
        old = np.flatnonzero(number >= 0)
        counts = np.zeros(len(words), np.int64)
        counts[new], counts[old] = count, memory.count[number[old]]
        take = ranges(memory.first[number[old]], counts[old])
        first = np.zeros(len(words), np.int64)
        first[new] = np.cumsum(count) - count
        first[old] = len(ids) + np.cumsum(counts[old]) - counts[old]
        pool = np.concatenate([ids, memory.ids[take]])
        pool_spans = np.concatenate([spans, memory.spans[take]]) if self.with_spans else None
        if keeps:
            own, k = np.flatnonzero(np.repeat(short, count)), new[short]
            self.memory.add(hashes[k], data, start[k], length[k], ids[own], count[short], spans[own] if self.with_spans else None)
        return pool, pool_spans, first, counts

    def encode(self, texts: pa.Array, spans: bool = False):
        """(ids, boundaries per text[, character spans in the text]).

        NULL is empty.  Spans are code-point positions ``[start, end)`` in the
        original text; the encoder must have been made for them.
        """
        if spans and not self.with_spans:
            raise ValueError("this encoder keeps no spans")
        pieces = cut_pieces(texts, lower=_folds_case(texts))
        pool, pool_spans, first, counts = self._pool(pieces)
        counts = counts[pieces.index]
        take = ranges(first[pieces.index], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[pieces.first]
        ids = pool[take]
        if not spans:
            return ids, bounds
        chars = np.concatenate([[0], np.cumsum((pieces.data & 0xC0) != 0x80)])  # code points before a byte
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(pieces.first))
        begin = chars[pieces.start] - chars[pieces.bounds[owner]]
        at = pool_spans[take] + np.repeat(begin, counts)[:, None]
        return ids, bounds, at

    def check_splits(self, texts: list[str]) -> bool:
        """Whether the pieces give the library's own ids for these texts."""
        ids, bounds = self.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return all(ids[a:b].tolist() == w for a, b, w in zip(bounds, bounds[1:], want))


def _folds_case(texts: pa.Array) -> bool:
    """Whether A-Z may be lower-cased first (fewer distinct pieces, same ids).

    The vocabulary's normaliser lower-cases after composing characters.  The
    order matters only where a combining mark follows a letter, and special
    strings are matched before, so batches with marks or special strings are
    left as they are.
    """
    data = cut_buffer(texts)[0]
    marks = bool(((data == 0xCC) | (data == 0xCD)).any())
    special = bool(((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any())
    return not marks and not special


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, special_as_text: bool = False, spans: bool = False) -> TextEncoder:
    """One encoder per Python worker and vocabulary file."""
    key = (path, special_as_text, spans)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, special_as_text, spans=spans)
    return _encoders[key]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
