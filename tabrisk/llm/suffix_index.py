"""Removal of long repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of a smaller identifier or earlier in the same one.

**Suffix arrays.**  Of all suffixes only those at *anchors* are kept: every
window of ``length`` bytes has one, the first of its ``KEY``-byte strings with
the smallest hash, so equal windows have it at the same place.  A run of
windows with the same anchor is one entry: the hash of the anchor's string, the
hash of all bytes its windows cover, document and place (about one entry in 31
bytes).  A batch's suffix array is these entries sorted by both hashes and
place, dealt to fragments by the first.

**Family.**  Documents come in batches of rising identifiers.  A batch's array
is merge-scanned with those of all levels: an entry whose covered bytes occur
earlier repeats as a whole; the first entry of an anchor string is new; what is
left shares an anchor with something earlier but not all of its bytes.  Then
the batch becomes a level, and levels of equal size are merged, as in a binary
counter, so an entry is written once a doubling.

**Partial matches.**  For the entries left, and those they share the anchor
with, the covered bytes are fetched from the texts and compared window by
window.  Anchors shared by more than ``WIDE`` different entries send windows
instead of bytes, dealt by window, so no group grows with the input.

Copies are dropped where they are first seen (in a task, a fragment, a bucket of
documents), leaving the earliest; a passage in a third of all documents is one
entry a task.  Equality is by two 64-bit hashes together.

Defined results: NULL texts are empty; texts shorter than ``length`` stay; NULL
identifiers come first; rows that share an identifier are documents of their own
in the order of their texts' SHA-256; rows that repeat identifier *and* text are
one document and all get its result; an empty table gives an empty result;
other columns are not read.  Kept bytes need not be valid UTF-8 (a removed run
may begin within a character), so they are returned as binary.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.pieces import cut_buffer, ranges, text_slices
from tabrisk.llm.shared import cut

LENGTH = 100
BATCHES = 4                  # batches a whole table is added in
CHUNK = 1 << 20              # bytes hashed at once
FLUSH = 1 << 19              # entries a task holds before it sends them
FRAGMENT_BYTES = 16 << 20    # text bytes behind a fragment, and in a bucket
WIDE = 5_000                 # entries of one anchor that are compared in one group

ENTRY, RUN, SPAN, NEED, DOCS, CONTENT, WINDOW = range(7)
_ROW = "dest bigint, kind int, level int, data binary"
_DTYPES = {ENTRY: ("<u8", "<u8", "<i8", "<i4", "<u2"),      # anchor, content, document, start, bytes
           SPAN: ("<i8", "<i4", "<i4"),                      # document, start, stop
           NEED: ("<u8", "<i8", "<i4", "<u2", "<u1"),        # anchor, document, start, bytes, wide
           CONTENT: ("<u8", "<i8", "<i4", "<u2"),            # anchor, document, start, bytes; and the bytes
           WINDOW: ("<u8", "<u8", "<i8", "<i4")}             # anchor, window, document, start
_DTYPES[RUN] = _DTYPES[ENTRY]


# ---- hashes and anchors ------------------------------------------------------

_A, _B, _C = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A + (right ^ (right >> np.uint64(29))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def _sizes(length: int) -> tuple[int, int]:
    """(bytes of an anchor's string, largest power of two within a window)."""
    half = 1 << (length.bit_length() - 1)
    return max(half // 2, 1), half


def _doubled(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of both sizes at every byte, by doubling."""
    key, half = _sizes(length)
    h = x.astype(np.uint64) * _C + np.uint64(1)
    h ^= h >> np.uint64(31)
    short, n = h, 1
    while n < half:
        h = _mix(h[:-n], h[n:])
        n *= 2
        if n == key:
            short = h
    return short, h


def _windows(x: np.ndarray, at: np.ndarray, half_hash: np.ndarray, length: int) -> np.ndarray:
    return _mix(half_hash[at], half_hash[at + length - _sizes(length)[1]])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, chunk: int = CHUNK):
    """Entries of the texts ``data[bounds[i]:bounds[i + 1]]``, chunk by chunk:
    (anchor, content, text number, start in the text, bytes covered)."""
    key, half = _sizes(length)
    width = length - key + 1
    for c in range(0, len(data), chunk):
        x = data[c:c + chunk + length - 1]
        low = np.searchsorted(bounds, c, "right") - 1
        high = np.searchsorted(bounds, min(c + chunk, len(data)), "left")
        begin = np.maximum(bounds[low:high], c)
        counts = np.maximum(np.minimum(bounds[low + 1:high + 1] - length, c + chunk - 1) - begin + 1, 0)
        if not counts.any():
            continue
        at = ranges(begin, counts)
        short, long = _doubled(x, length)
        least = (short >> np.uint64(24) << np.uint64(24)) | np.arange(len(short), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[:len(least) - (width - n)], least[width - n:])
        anchor = (least[at - c] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)]))
        last = np.append(first[1:], len(at)) - 1
        start = at[first]
        size = at[last] - start + length
        content = size.astype(np.uint64)
        for i in range(4):                       # four strings cover up to four halves
            content = _mix(content, long[start - c + (size - half) * i // 3])
        owner = np.repeat(np.arange(low, high), counts)[first]
        yield short[anchor[first]], content, owner, start - bounds[owner], size


# ---- packed rows ---------------------------------------------------------------

def _pack(kind: int, arrays, tail: bytes = b"") -> bytes:
    """Columns as compressed byte planes; the first is ascending if it is a hash."""
    import zstandard

    planes = []
    for k, (dtype, a) in enumerate(zip(_DTYPES[kind], arrays)):
        a = np.asarray(a).astype(dtype)
        if k == 0 and dtype == "<u8":
            a = np.diff(a, prepend=a.dtype.type(0))
        planes.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes())
    head = np.array([len(arrays[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes) + tail)


def _unpack(kind: int, data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, place, out = int(raw[:8].view("<i8")[0]), 8, []
    for k, dtype in enumerate(_DTYPES[kind]):
        size = np.dtype(dtype).itemsize
        a = np.ascontiguousarray(raw[place:place + n * size].reshape(size, n).T).view(dtype).reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64) if k == 0 and dtype == "<u8" else a)
        place += n * size
    return out, raw[place:]


def _gather(rows, *kinds: int) -> list[np.ndarray]:
    """Columns of all rows of these kinds, one after the other."""
    got = [_unpack(kinds[0], data)[0] for kind, data in rows if kind in kinds]
    return [np.concatenate([g[k] for g in got]) if got else np.zeros(0, d) for k, d in enumerate(_DTYPES[kinds[0]])]


def _dealt(kind: int, dest: np.ndarray, arrays, level: int = -1):
    """A row for each destination, its columns in the order they come in."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cuts = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]])) if len(dest) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(dest))):
        yield int(dest[a]), kind, level, _pack(kind, [c[order[a:b]] for c in arrays])


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc ^ (doc >> 17)) % buckets


def _united(doc, start, stop):
    """Overlapping and touching spans of a document made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(doc):
        return doc, start, stop
    number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    lift = number * (int(stop.max()) + 1)                     # documents one after the other
    reach = np.maximum.accumulate(stop + lift)
    first = np.flatnonzero(np.concatenate([[True], (start[1:] + lift[1:] > reach[:-1]) | (number[1:] != number[:-1])]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - lift[last]


def _spans(doc, start, stop, buckets: int, passing: bool):
    """SPAN rows; on their way through a job keyed by fragment, ``passing``."""
    doc, start, stop = _united(doc, start, stop)
    for dest, *row in _dealt(SPAN, _bucket(doc, buckets), [doc, start, stop]):
        yield (-1 - dest if passing else dest), *row


def _table(rows) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    ["dest", "kind", "level", "data"])


def _passed(table: pa.Table):
    """SPAN rows that only pass through, to their buckets."""
    for dest, kind, level, data in zip(*(table.column(c).to_pylist() for c in ("dest", "kind", "level", "data"))):
        if kind == SPAN:
            yield -1 - dest, kind, level, data


def _rows(table: pa.Table):
    return list(zip(table.column("kind").to_pylist(), table.column("data").to_pylist()))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before in any of the keys."""
    differs = np.ones(len(keys[0]), bool)
    if len(differs):
        differs[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return differs


# ---- the family ------------------------------------------------------------------

class SuffixIndex:
    """Levels of suffix arrays over documents (``_doc`` bigint, ``_text`` string),
    which are added in batches of rising ``_doc``."""

    def __init__(self, fragments: int, length: int = LENGTH, wide: int = WIDE, flush: int = FLUSH, chunk: int = CHUNK):
        if not 2 <= length <= 16_384:
            raise ValueError("length must be 2 to 16384")
        self.fragments, self.buckets = fragments, fragments | 1
        self.length, self.wide, self.flush, self.chunk = length, wide, flush, chunk
        self.levels: list[tuple[int, int, DataFrame]] = []    # (batches, number, rows)
        self.found: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def add(self, docs: DataFrame, insert: bool = True) -> None:
        """Scan a batch against all levels and, if ``insert``, make it one."""
        number, size, stay = len(self.found), 1, list(self.levels)
        while stay and stay[-1][0] == size:
            stay.pop()
            size *= 2
        merged = {n for _, n, _ in self.levels[len(stay):]}
        rows = reduce(DataFrame.union, [r for _, _, r in self.levels], docs.mapInArrow(self._array(), _ROW))
        out = cut(rows.groupBy("dest").applyInArrow(self._merge_scan(number if insert else None, merged), _ROW))
        self.found.append(out.where(F.col("kind").isin(SPAN, NEED)))
        self.texts.append(docs)
        if insert:
            self.levels = [*stay, (size, number, out.where(F.col("kind") == RUN))]

    def _array(self):
        """Entries of a partition's texts, the earliest of equal ones."""
        fragments, buckets, length, flush, chunk = self.fragments, self.buckets, self.length, self.flush, self.chunk

        def send(parts):
            h, e, doc, start, size = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((start, doc, e, h))
            h, e, doc, start, size = (c[order] for c in (h, e, doc, start, size))
            first = _starts(h, e)
            yield from _spans(doc[~first], start[~first], (start + size)[~first], buckets, True)
            yield from _dealt(ENTRY, (h[first] % np.uint64(fragments)).astype(np.int64), [c[first] for c in (h, e, doc, start, size)])

        def array(batches):
            parts, held = [], 0
            for batch in batches:
                for piece in text_slices(batch, "_text"):
                    docs = piece.column("_doc").to_numpy()
                    for h, e, owner, start, size in anchors(*cut_buffer(piece.column("_text")), length, chunk):
                        parts.append((h, e, docs[owner], start, size))
                        held += len(h)
                        if held >= flush:
                            yield from _table(send(parts)).to_batches()
                            parts, held = [], 0
            if parts:
                yield from _table(send(parts)).to_batches()

        return array

    def _merge_scan(self, number, merged):
        """New entries of a fragment among those of the levels."""
        buckets, wide = self.buckets, self.wide

        def scan(table: pa.Table) -> pa.Table:
            out = list(_passed(table))
            new = _gather([r for r in _rows(table) if r[0] == ENTRY], ENTRY)
            old = [(level, _unpack(RUN, data)[0]) for kind, level, data in zip(
                *(table.column(c).to_pylist() for c in ("kind", "level", "data"))) if kind == RUN]
            level = np.concatenate([np.full(len(new[0]), -1), *(np.full(len(a[0]), n) for n, a in old)])
            h, e, doc, start, size = (np.concatenate([new[k], *(a[k] for _, a in old)]) for k in range(5))
            order = np.lexsort((start, doc, e, h))             # runs come sorted: a merge
            h, e, doc, start, size, level = (c[order] for c in (h, e, doc, start, size, level))
            first = _starts(h, e)
            again = ~first & (level < 0)
            out += _spans(doc[again], start[again], (start + size)[again], buckets, False)
            h, e, doc, start, size, level = (c[first] for c in (h, e, doc, start, size, level))
            # different entries of one anchor, one of them new: compared by their bytes
            group = np.cumsum(_starts(h)) - 1
            many = np.bincount(group)
            has_new = np.bincount(group, level < 0) > 0
            need = ((many > 1) & has_new)[group]
            out += _dealt(NEED, _bucket(doc[need], buckets), [
                c[need] for c in (h, doc, start, size, (many > wide)[group])])
            if number is not None:
                stay = (level < 0) | np.isin(level, list(merged))
                if stay.any():
                    dest = int(table.column("dest")[0].as_py())
                    out.append((dest, RUN, number, _pack(RUN, [c[stay] for c in (h, e, doc, start, size)])))
            return _table(out)

        return scan

    # -- partial matches and results --

    def _packed(self) -> DataFrame:
        """Texts by bucket, compressed."""
        buckets = self.buckets

        def pack(batches):
            def send(held):
                table = pa.Table.from_batches(held)
                dest = _bucket(table.column("_doc").to_numpy(), buckets)
                order = np.argsort(dest, kind="stable")
                cuts = np.flatnonzero(_starts(dest[order]))
                for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                    sink = pa.BufferOutputStream()
                    part = table.take(pa.array(order[a:b])).combine_chunks()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(part)
                    yield int(dest[order[a]]), DOCS, -1, sink.getvalue().to_pybytes()

            held, size = [], 0
            for batch in batches:
                for piece in text_slices(batch, "_text"):
                    held.append(piece)
                    size += len(cut_buffer(piece.column("_text"))[0])
                    if size >= FRAGMENT_BYTES:
                        yield from _table(send(held)).to_batches()
                        held, size = [], 0
            if held:
                yield from _table(send(held)).to_batches()

        return reduce(DataFrame.union, self.texts).mapInArrow(pack, _ROW)

    def _fetch(self):
        """The bytes that entries cover, dealt by anchor; windows of wide anchors."""
        fragments, buckets, length = self.fragments, self.buckets, self.length

        def fetch(docs: pa.Table, needs: pa.Table) -> pa.Table:
            h, doc, start, size, wide = _gather(_rows(needs), NEED)
            order = np.lexsort((wide, start, doc, h))
            order = order[_starts(*(c[order] for c in (h, doc, start, wide)))]   # asked for by several batches
            h, doc, start, size, wide = (c[order] for c in (h, doc, start, size, wide))
            data, bounds, ids = _opened(docs)
            place = np.argsort(ids)
            at = bounds[place[np.searchsorted(ids[place], doc)]] + start if len(doc) else start.astype(np.int64)
            out = []
            dest = (h % np.uint64(fragments)).astype(np.int64)
            narrow = np.flatnonzero(wide == 0)
            for f in np.unique(dest[narrow]):
                k = narrow[dest[narrow] == f]
                out.append((int(f), CONTENT, -1, _pack(CONTENT, [c[k] for c in (h, doc, start, size)],
                                                       data[ranges(at[k], size[k].astype(np.int64))].tobytes())))
            k = np.flatnonzero(wide)
            if len(k):
                own, w, whose, where = _window_rows(data, h[k], doc[k], start[k], size[k], at[k], length)
                spans, kept = _first_windows(own, w, whose, where, length)
                out += _spans(*spans, buckets, True)
                out += _dealt(WINDOW, (kept[1] % np.uint64(fragments)).astype(np.int64), kept)
            return _table(out)

        return fetch

    def _compare(self):
        """Windows that also occur earlier, among those of one fragment."""
        buckets, length = self.buckets, self.length

        def compare(table: pa.Table) -> pa.Table:
            out = list(_passed(table))
            rows = _rows(table)
            found = [_gather(rows, WINDOW)]
            for kind, raw in rows:
                if kind == CONTENT:
                    (h, doc, start, size), data = _unpack(CONTENT, raw)
                    at = np.cumsum(size, dtype=np.int64) - size
                    found.append(_window_rows(data, h, doc, start, size, at, length))
            spans, _ = _first_windows(*(np.concatenate(c) for c in zip(*found)), length)
            out += _spans(*spans, buckets, False)
            return _table(out)

        return compare

    def results(self) -> DataFrame:
        """``_doc, n_bytes, spans, kept`` of all documents added."""
        packed = self._packed()
        found = reduce(DataFrame.union, self.found)
        needs = found.where(F.col("kind") == NEED)
        partial = packed.groupBy("dest").cogroup(needs.groupBy("dest")).applyInArrow(self._fetch(), _ROW).groupBy(
            "dest").applyInArrow(self._compare(), _ROW)
        spans = found.where(F.col("kind") == SPAN).union(partial)
        return packed.groupBy("dest").cogroup(spans.groupBy("dest")).applyInArrow(_finish, _RESULT)


_RESULT = "_doc bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def _opened(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, boundaries, document numbers) of a bucket."""
    parts = []
    for raw in docs.column("data").to_pylist():
        with pa.ipc.open_stream(pa.py_buffer(raw)) as stream:
            parts += stream.read_all().to_batches()
    cuts = [cut_buffer(p.column("_text")) for p in parts]
    if not cuts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    sizes = np.concatenate([np.diff(b) for _, b in cuts])
    return (np.concatenate([d for d, _ in cuts]), np.concatenate([[0], np.cumsum(sizes)]),
            np.concatenate([p.column("_doc").to_numpy() for p in parts]))


def _window_rows(data, h, doc, start, size, at, length):
    """(anchor, window, document, start) of every window of entries at ``at``."""
    counts = size.astype(np.int64) - length + 1
    piece = ranges(at.astype(np.int64), size.astype(np.int64))
    begin = np.cumsum(size, dtype=np.int64) - size
    x = data[piece]
    place = ranges(begin, counts)
    own = np.repeat(np.arange(len(h)), counts)
    w = _windows(x, place, _doubled(x, length)[1], length) if len(place) else np.zeros(0, np.uint64)
    return h[own], w, doc[own], (start[own] + place - begin[own]).astype(np.int64)


def _first_windows(h, w, doc, start, length):
    """Spans of windows that occur earlier, and the first windows of their kind."""
    order = np.lexsort((start, doc, w, h))
    h, w, doc, start = (c[order] for c in (h, w, doc, start))
    first = _starts(h, w)
    again = ~first & _starts(h, w, doc, start)      # the same window twice is no repetition
    return (doc[again], start[again], start[again] + length), [c[first] for c in (h, w, doc, start)]


def _finish(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Texts of a bucket without the spans."""
    data, bounds, ids = _opened(docs)
    doc, start, stop = _united(*_gather(_rows(spans), SPAN))
    place = np.argsort(ids)
    own = place[np.searchsorted(ids[place], doc)] if len(doc) else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    own, start, stop = own[order], start[order], stop[order]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[bounds[own] + start] += 1                   # spans of a document neither meet nor overlap
    np.subtract.at(edge, bounds[own] + stop, 1)      # but one may end where the next text's begins
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pa.table([
        pa.array(ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(ids)))]), pa.int32()),
                                 pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["start", "stop"])),
        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [
            None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))]).cast(pa.binary())],
        ["_doc", "n_bytes", "spans", "kept"])


# ---- the operator ------------------------------------------------------------------

def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """(``_doc, _text``; for tables whose identifiers are no numbers of their own,
    ``_doc``, identifier and how often the row occurs; bytes of text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    own = dict(rows.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint")
    twice = rows.groupBy("_id").count().where("_id IS NULL OR count > 1").limit(1)
    if own and not twice.count():
        return rows.select(F.col("_id").cast("bigint").alias("_doc"), "_text"), None, size
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    keys = cut(rows.groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_copies")).orderBy(
        F.asc_nulls_first("_id"), "_sha").withColumn("_doc", F.monotonically_increasing_id()))
    same = F.col("k._id").eqNullSafe(F.col("r._id")) & (F.col("k._sha") == F.col("r._sha"))
    texts = rows.alias("r").join(keys.alias("k"), same).groupBy("_doc").agg(F.min("_text").alias("_text"))
    return cut(texts), keys.select("_doc", "_id", "_copies"), size


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   batches: int = BATCHES, fragments: int | None = None, **options) -> DataFrame:
    """A row for each row of ``docs``: ``<id>, n_bytes, spans, kept``; spans are the
    maximal runs of removed bytes, kept the bytes that stay."""
    texts, keys, size = _numbered(docs, id_col, text_col)
    index = SuffixIndex(fragments or max(8, -(-size // FRAGMENT_BYTES)), length, **options)
    cuts = texts.agg(F.percentile_approx("_doc", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        inside: Column = F.lit(True)
        if low is not None:
            inside &= F.col("_doc") > low
        if high is not None:
            inside &= F.col("_doc") <= high
        index.add(texts.where(inside), insert=k < len(cuts))
    out = index.results()
    if keys is None:
        kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
        return out.select(F.col("_doc").cast(kind).alias(id_col), "n_bytes", "spans", "kept")
    out = out.join(keys, "_doc").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(F.col("_id").alias(id_col), "n_bytes", "spans", "kept")
