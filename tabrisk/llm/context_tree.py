"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; every decision has, for each context of 0 to
``depth`` preceding bytes, a Krichevsky-Trofimov estimate from the counts of
the training texts.  A node of the context tree weighs its own estimate
against its children's by the probabilities both gave to the training data
(``Pw = KT/2 + prod(children Pw)/2``), so the prediction of a decision is a
mixture over all depths, with weights that depend on the context.  The fitted
tree is frozen for scoring: the score of a text is the sum of the log10
probabilities of its bytes, minus its code length.

The text that is scored is the sequence of its words (A-Z lower-cased, maximal
runs without ASCII white space) with one space between them and one newline as
end, so the word model beside it (add-one smoothed, ``base_score``) gives a
probability to the same event.

On Spark the tree is never in one place:

1. Texts are written once as compressed blocks to the checkpoint folder, and
   with them each block's distinct context+byte strings and words with their
   training counts, so texts are gone through once to count and once to score.
2. These go to fragments: strings by their two most recent context bytes, words
   by hash.  Counts are summed before the shuffle.
3. A fragment holds whole subtrees below depth 2 and works them out bottom-up.
   Of depth 1 and 0 there are at most 256 * 255 nodes; their counts and sums
   are collected, a proven bound, and broadcast.
4. Each fragment answers each block with the log probability of its strings
   and the counts of its words; a block meets its answers and scores its texts.

Defined results: NULL and empty texts are the end alone (one token); without
training texts every decision is 1/2 and the word model has N = V = 0; rows
keep NULL identifiers and repetitions; a very long text is scored whole, as a
slice of its own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.pieces import SPACE, cut_pieces, text_slices
from tabrisk.llm.shared import cut

DEPTH = 5                  # context bytes, at most 7
BLOCK_BYTES = 32 << 20     # text of a block
FRAGMENT_BYTES = 16 << 20  # text behind a fragment
SLICE = 1 << 20
END = 10                   # newline: end of a text, and what stands before its start
STRINGS, WORDS_, TOP, BLOCK = 0, 1, 2, 3

_SENT = "frag int, block bigint, kind int, key binary, count binary"


# ---- texts as strings of context and byte ----------------------------------

class Slice:
    """Strings and words of some texts.

    ``key``: context and byte of every position, most recent context byte in
    the highest byte; ``bounds``: positions per text; ``word``: hash of every
    word; ``word_bounds``: words per text.
    """

    def __init__(self, texts: pa.Array, depth: int):
        pieces = cut_pieces(texts, lower=True)
        docs = len(texts)
        first, counts = pieces.first, np.diff(pieces.first)
        spaces = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
        at = np.concatenate([[0], np.cumsum(pieces.length)])   # word bytes before each word
        owner = np.repeat(np.arange(docs), counts)
        base = depth + at[:-1] + (np.arange(len(owner)) - first[owner]) + spaces[owner] + depth * owner
        stop = depth + at[first[1:]] + spaces[1:] + depth * np.arange(docs)   # where the text's end stands
        start = depth + at[first[:-1]] + spaces[:-1] + depth * np.arange(docs)
        x = np.full(int(stop[-1]) + 1 if docs else 0, END, np.uint8)
        text = np.ones(len(x), bool)                           # bytes of a text, its end included
        text[(start[:, None] - 1 - np.arange(depth)).ravel()] = False
        text[stop] = True                                      # also the context of the next text
        spaced = (base - 1)[np.arange(len(owner)) != first[owner]]
        x[spaced] = 32
        word = text.copy()
        word[spaced] = word[stop] = False
        x[word] = pieces.data[~SPACE[pieces.data]]
        size = stop - start + 1
        key = np.zeros(max(len(x) - depth, 0), np.uint64)     # of all bytes that have a context
        for back in range(1, depth + 1):
            key |= x[depth - back:len(x) - back]
            key <<= np.uint64(8)
        key |= x[depth:]
        self.key = key[text[depth:]]
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        hashes = (pd.util.hash_array(np.array(pieces.words.to_pylist(), object)) if len(pieces.words)
                  else np.zeros(0, np.uint64))
        self.word = hashes[pieces.index]
        self.word_bounds = first


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, counts, len(own)).astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes())


def _unpack_keys(raw: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u8"), dtype=np.uint64)


def _string_fragment(key: np.ndarray, depth: int, fragments: int) -> np.ndarray:
    recent = key >> np.uint64(8 * (depth - 1)) if depth > 1 else key >> np.uint64(8)
    return (((recent * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(fragments)).astype(np.int64)


def _word_fragment(key: np.ndarray, fragments: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(fragments)).astype(np.int64)


def _tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs where ``train``."""
    own = np.sort(keys[train])
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rest = np.unique(keys[~train])
    return _count([(own[first], np.diff(np.append(first, len(own)))), (rest, np.zeros(len(rest), np.int64))])


# ---- blocks ------------------------------------------------------------------

def _open(data: bytes):
    with pa.ipc.open_stream(pa.py_buffer(data)) as stream:
        for batch in stream:
            yield from text_slices(batch, "text", SLICE)


def _block_rows(block: int, parts: list[pa.RecordBatch], strings, words, fragments: int, depth: int):
    """The rows of one block: its texts, and what it sends to each fragment."""
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches(parts)
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(whole)
    docs = sum(int(p.column("train").to_numpy(zero_copy_only=False).sum()) for p in parts)
    yield -1, block, BLOCK, sink.getvalue().to_pybytes(), b""
    yield block % fragments, block, TOP, b"", np.array([docs], "<i4").tobytes()
    for kind, (key, count), frag in ((STRINGS, strings, _string_fragment(strings[0], depth, fragments)),
                                     (WORDS_, words, _word_fragment(words[0], fragments))):
        order = np.argsort(frag, kind="stable")
        cuts = np.searchsorted(frag[order], np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[f]:cuts[f + 1]]
            yield int(f), block, kind, _pack_keys(key[at]), count[at].astype("<i4").tobytes()


def _blocks(docs: DataFrame, train, id_col: str, text_col: str, depth: int, fragments: int) -> DataFrame:
    """Rows of :func:`_block_rows` for blocks of about ``BLOCK_BYTES`` of text."""
    def write(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 20
        held, size, strings, words = [], 0, [], []

        def rows():
            made = _block_rows(block, held, _count(strings), _count(words), fragments, depth)
            for row in made:
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, (
                    pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    ["frag", "block", "kind", "key", "count"])

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                own = Slice(part.column("text"), depth)
                flag = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                strings.append(_tally(own.key, np.repeat(flag, np.diff(own.bounds))))
                words.append(_tally(own.word, np.repeat(flag, np.diff(own.word_bounds))))
                if len(strings) >= 6:
                    strings, words = [_count(strings)], [_count(words)]
                held.append(part)
                size += len(own.key)
                if size >= BLOCK_BYTES:
                    yield from rows()
                    held, size, strings, words, block = [], 0, [], [], block + 1
        if held:
            yield from rows()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(write, _SENT)


# ---- the tree ----------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling's series above 8)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift - np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def _nodes(level: np.ndarray, counts: np.ndarray):
    """Binary nodes of the strings ``context << 8 | byte``: (node keys, n0, n1).

    The node key is the context followed by 1 and the bits decided so far."""
    byte, context = level & np.uint64(255), level >> np.uint64(8) << np.uint64(8)
    keys, bits = [], []
    for j in range(8):
        keys.append(context | np.uint64(1 << j) | (byte >> np.uint64(8 - j)))
        bits.append((byte >> np.uint64(7 - j)) & np.uint64(1))
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    one = np.concatenate(bits).astype(bool)
    weight = np.tile(counts, 8).astype(float)
    n1 = np.bincount(at, weight * one, len(own))
    return own, np.bincount(at, weight * ~one, len(own)), n1


def _weigh(n0, n1, children):
    """(log Pw, stopping weight) of nodes given the log Pw of their children."""
    own = log_kt(n0, n1)
    both = np.logaddexp(own, children) - np.log(2)
    return both, np.exp(np.clip(own - np.log(2) - both, -700, 0))


class Subtrees:
    """Whole subtrees below depth 2 of the strings with ``counts`` > 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        keys, counts = keys[counts > 0], counts[counts > 0]
        self.depth, self.levels = depth, {}
        above = None
        for d in range(depth, 1, -1):
            level, n = _count([((keys >> np.uint64(8 * (depth - d) + 8)) << np.uint64(8) | (keys & np.uint64(255)), counts)])
            own, n0, n1 = _nodes(level, n)
            if above is None:
                weighted, stop = log_kt(n0, n1), np.ones(len(own))
            else:
                child, log_w = above
                parent = (child >> np.uint64(16)) << np.uint64(8) | (child & np.uint64(255))
                weighted, stop = _weigh(n0, n1, np.bincount(np.searchsorted(own, parent), log_w, len(own)))
            self.levels[d] = (own, stop, (n1 + 0.5) / (n0 + n1 + 1))
            above = own, weighted
        self.second = above
        # depth 1: counts and the log Pw of the children, to be added up over the fragments
        level, n = _count([((keys >> np.uint64(8 * depth)) << np.uint64(8) | (keys & np.uint64(255)), counts)])
        self.top = _nodes(level, n)
        child, log_w = above
        parent = (child >> np.uint64(16)) << np.uint64(8) | (child & np.uint64(255))
        self.top_children = np.bincount(np.searchsorted(self.top[0], parent), log_w, len(self.top[0]))

    def log10(self, keys: np.ndarray, top: "Top") -> np.ndarray:
        """log10 probability of the byte of each string after its context."""
        out = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for j in range(8):
            node = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            p = np.full(len(keys), 0.5)
            for d in range(self.depth, 1, -1):
                own, stop, one = self.levels[d]
                key = (keys >> np.uint64(8 * (self.depth - d) + 8)) << np.uint64(8) | node
                at = np.minimum(np.searchsorted(own, key), max(len(own) - 1, 0))
                seen = own[at] == key if len(own) else np.zeros(len(keys), bool)
                if len(own):
                    p = np.where(seen, stop[at] * one[at] + (1 - stop[at]) * p, 0.5)
            recent = (keys >> np.uint64(8 * self.depth)).astype(np.int64)
            node = node.astype(np.int64)
            p = top.one_stop[recent, node] * top.one_p[recent, node] + (1 - top.one_stop[recent, node]) * p
            p = top.root_stop[node] * top.root_p[node] + (1 - top.root_stop[node]) * p
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            out += np.log10(np.where(bit, p, 1 - p))
        return out


class Top:
    """Depth 1 and 0 of the tree: at most 256 * 255 nodes."""

    def __init__(self, rows):
        n0, n1, lw = (np.zeros((256, 256)) for _ in range(3))
        for r in rows:
            n0[r["context"], r["node"]], n1[r["context"], r["node"]] = r["n0"], r["n1"]
            lw[r["context"], r["node"]] = r["lw"]
        weighted, stop = _weigh(n0, n1, lw)
        seen = n0 + n1 > 0
        # an unseen node is 1/2, like everything below it
        self.one_stop, self.one_p = np.where(seen, stop, 1.0), np.where(seen, (n1 + 0.5) / (n0 + n1 + 1), 0.5)
        a, b = n0.sum(0), n1.sum(0)
        _, self.root_stop = _weigh(a, b, np.where(seen, weighted, 0.0).sum(0))
        self.root_p = (b + 0.5) / (a + b + 1)
        self.root_stop = np.where(a + b > 0, self.root_stop, 1.0)


def _read(rows, kind):
    return [(_unpack_keys(r["key"]), np.frombuffer(r["count"], "<i4")) for r in rows if r["kind"] == kind]


def _tops(depth: int):
    def top(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tree = Subtrees(*_count(_read(rows, STRINGS)), depth)
        own, n0, n1 = tree.top
        _, words = _count(_read(rows, WORDS_))
        docs = sum(int(np.frombuffer(r["count"], "<i4")[0]) for r in rows if r["kind"] == TOP)
        extra = [words.sum(), (words > 0).sum(), docs]
        return pa.table({
            "context": pa.array(np.append((own >> np.uint64(8)).astype(np.int32), -1), pa.int32()),
            "node": pa.array(np.append((own & np.uint64(255)).astype(np.int32), 0), pa.int32()),
            "n0": np.append(n0, float(extra[0])), "n1": np.append(n1, float(extra[1])),
            "lw": np.append(tree.top_children, float(extra[2]))})

    return top


def _answers(depth: int, top: Top):
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, counts = _count(_read(rows, STRINGS))
        values = Subtrees(keys, counts, depth).log10(keys, top)
        words, total = _count(_read(rows, WORDS_))
        out = []
        for r in rows:
            if r["kind"] == STRINGS:
                got = values[np.searchsorted(keys, _unpack_keys(r["key"]))]
                out.append((r["block"], STRINGS, r["key"], got.astype("<f4").tobytes()))
            elif r["kind"] == WORDS_:
                got = total[np.searchsorted(words, _unpack_keys(r["key"]))]
                out.append((r["block"], WORDS_, r["key"], got.astype("<i8").tobytes()))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (
            pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "key", "value"])

    return answer


def _merged(rows, kind, dtype):
    """Answered keys in order, with their values."""
    keys = [_unpack_keys(r["key"]) for r in rows if r["kind"] == kind]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys = np.concatenate(keys)
    values = np.concatenate([np.frombuffer(r["value"], dtype) for r in rows if r["kind"] == kind])
    order = np.argsort(keys)
    return keys[order], values[order].astype(float)


def _scores(depth: int, tokens: int, distinct: int, docs: int):
    floor = tokens + distinct + 1

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
        out = []
        got = answers.to_pylist()
        strings, value = _merged(got, STRINGS, "<f4")
        words, known = _merged(got, WORDS_, "<i8")
        for data in block.column("key"):
            data = data.as_buffer().to_pybytes()
            base = np.log10((known + 1) / floor)
            end = np.log10((docs + 1) / floor)
            for part in _open(data):
                own = Slice(part.column("text"), depth)
                hashes, place = np.unique(own.word, return_inverse=True)
                at = np.searchsorted(words, hashes)[place]
                n = np.diff(own.word_bounds)
                owner = np.repeat(np.arange(len(n)), n)
                # each distinct string is looked up once, in order
                keys, place = np.unique(own.key, return_inverse=True)
                bits = value[np.searchsorted(strings, keys)][place]
                out.append(pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("train"), pa.array(n + 1),
                    pa.array(np.bincount(owner, known[at] > 0, len(n)).astype(np.int64) + (docs > 0)),
                    pa.array(np.bincount(owner, base[at], len(n)) + end),
                    pa.array(np.add.reduceat(bits, own.bounds[:-1])), pa.array(np.diff(own.bounds))], names))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds)))
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    return score


def context_tree_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                        depth: int = DEPTH) -> DataFrame:
    """Scores of every row, learnt from the rows that satisfy ``train``:
    ``<id>, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes``.
    ``-score / log10(2) / n_bytes`` is the code length in bits per byte."""
    spark = docs.sparkSession
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    rows = cut(_blocks(docs, train, id_col, text_col, depth, fragments))
    blocks, sent = rows.where(F.col("kind") == BLOCK), rows.where(F.col("kind") != BLOCK)
    tops = sent.groupBy("frag").applyInArrow(
        _tops(depth), "context int, node int, n0 double, n1 double, lw double").groupBy("context", "node").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "lw")]).collect()  # at most 256 * 255 + 1 rows
    totals = [r for r in tops if r["context"] < 0]
    words, distinct, ends = (int(totals[0][c]) for c in ("n0", "n1", "lw")) if totals else (0, 0, 0)
    tokens, distinct = words + ends, distinct + (ends > 0)
    top = Top([r for r in tops if r["context"] >= 0])
    answers = sent.groupBy("frag").applyInArrow(
        _answers(depth, top), "block bigint, kind int, key binary, value binary")
    spread = 4 * max(1, blocks.count())  # so that few tasks get two blocks
    scored = blocks.repartition(spread, "block").groupBy("block").cogroup(
        answers.repartition(spread, "block").groupBy("block")).applyInArrow(
        _scores(depth, tokens, distinct, ends),
        "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint")
    return scored.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known",
                         F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes")
