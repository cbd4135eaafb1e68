"""Exact n-gram Jaccard self-join by vertical partitioning.

The shingles of all texts have one global order (their 64-bit hash), which is
cut into fragments.  Every fragment sees, for every text, only the part of its
shingle set that falls into it, and counts there; partial counts are summed.

1. *Overlap with the corpus.*  Each fragment finds which of its shingles occur
   in more than one text; summed over the fragments this bounds a text's
   overlap with any other text.  A text with less than 80 % shared shingles has
   no partner and needs nothing more.  Sets travel as packed arrays, a row for
   each block of texts and fragment.  A shingle that a block has twice is known
   to be shared: only one witness of it goes to its fragment, so a passage in a
   third of all texts costs one entry per block.
2. *Equal sets* become one representative, and step 1 is repeated among the
   representatives.
3. *Candidates.*  What is left is ordered rarest first; two linked sets share a
   shingle among the first ``n - ceil(0.8 n) + 1`` of each (shingles without a
   second text count as the rarest and can't match).  Texts that share such a
   shingle, directly or through others, form a candidate group.
4. *Partial overlaps.*  A candidate group is cut into chunks, and the order of the
   shingles into vertical parts.  For every two chunks and every part one task
   counts, from that part of the sets alone, the overlap of all pairs as a matrix
   product and emits the counts as one packed block; small groups share a task.
5. *Sum per pair.*  The blocks of the parts meet by chunk pair, are summed and
   compared with the threshold.  Only a spanning forest of the links leaves the
   task, never the pairs, so a large group of near copies that are not near each
   other costs arithmetic, not rows.

``min_percent`` is compared in integers: ``100 * overlap >= min_percent * union``.

Defined results: words are maximal runs without ASCII white space of the text
with A-Z lower-cased; a text with fewer than ``words`` words is one shingle, a
NULL text or one without words has the empty set and links with nothing; a
NULL identifier takes part but never names a component unless all its members'
are NULL; repeated rows are texts like any other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm.components import connected_components
from tabrisk.llm.pieces import cut_pieces, ranges, text_slices
from tabrisk.llm.shared import cut

WORDS = 5
MIN_PERCENT = 80
TEXTS_PER_FRAGMENT = 2500
CHUNK = 1000          # texts of a candidate group in one chunk
PARTS = 4             # vertical parts in which chunks are compared
TOGETHER = 2000       # texts of small groups that are compared in one task
FRAGMENT_COLUMNS = 2048  # shingles of one matrix product
LOW = np.uint64((1 << 40) - 1)
SLICE = 1 << 20
BLOCK_SHINGLES = 800_000

_BLOB = "frag int, block bigint, kind int, doc binary, count binary, low binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) pairs, each once, sorted by text and hash."""
    pieces = cut_pieces(texts, lower=True)
    if not len(pieces.index):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = pd.util.hash_array(np.array(pieces.words.to_pylist(), object))[pieces.index]
    counts = np.diff(pieces.first)
    odd = np.uint64(0x9E3779B97F4A7C15)
    value = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for i in range(words):
        value = value * odd + word[i:i + len(value)]
    starts = ranges(pieces.first[:-1], np.maximum(counts - words + 1, 0))
    doc = np.repeat(np.arange(len(texts)), np.maximum(counts - words + 1, 0))
    value = _mix(value[starts])
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):  # the whole sequence, told apart from shingles by its length
        own = []
        for d in few:
            h = np.zeros(1, np.uint64)
            for w in word[pieces.first[d]:pieces.first[d + 1]]:
                h = h * odd + w
            own.append(_mix(h + np.uint64(counts[d]))[0])
        doc, value = np.concatenate([doc, few]), np.concatenate([value, np.array(own, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _five(x: np.ndarray) -> bytes:
    """40-bit numbers, five bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


# kinds of packed rows
_TEXTS, _TEST, _KNOWN, _WITNESS = 0, 1, 2, 3


def _deal(block: int, doc: np.ndarray, key: np.ndarray, fragments: int):
    """Packed rows of one block of texts: (frag, block, kind, doc, count, low)."""
    # a key that the block has twice is shared whatever the others have
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    rows = []

    def pack(kind, doc, key):
        frag = (key >> np.uint64(40)).astype(np.int64)
        order = np.lexsort((doc, frag))
        doc, key, frag = doc[order], key[order], frag[order]
        cuts = np.searchsorted(frag, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[f], cuts[f + 1]
            own, count = np.unique(doc[a:b], return_counts=True)
            rows.append((int(f), block, kind, own.astype("<i4").tobytes(), count.astype("<i4").tobytes(),
                         _five(key[a:b] & LOW)))

    pack(_TEST, doc[~twice], key[~twice])
    shared = np.unique(key[twice])
    pack(_WITNESS, np.zeros(len(shared), np.int64), shared)
    if twice.any():  # needs no answer: the block's own reducer gets it as it is
        own, count = np.unique(doc[twice], return_counts=True)
        rows.append((block % fragments, block, _KNOWN, own.astype("<i4").tobytes(), count.astype("<i4").tobytes(),
                     key[twice].astype("<u8").tobytes()))
    return rows


def _packed(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["frag", "block", "kind", "doc", "count", "low"])


def _answer(table: pa.Table) -> pa.Table:
    """One fragment: keep, per block and text, the shingles that another text has too."""
    rows = table.to_pylist()
    low = [_wide(r["low"]) if r["kind"] in (_TEST, _WITNESS) else np.zeros(0, np.uint64) for r in rows]
    values = np.concatenate(low) if low else np.zeros(0, np.uint64)
    values.sort()
    several = np.unique(values[1:][values[1:] == values[:-1]])
    del values
    out = []
    for r, own in zip(rows, low):
        if r["kind"] in (_TEXTS, _KNOWN):
            out.append((r["frag"], r["block"], r["kind"], r["doc"], r["count"], r["low"]))
        elif r["kind"] == _TEST and len(several):
            at = np.minimum(np.searchsorted(several, own), len(several) - 1)
            hit = several[at] == own
            if hit.any():
                doc = np.repeat(np.frombuffer(r["doc"], "<i4"), np.frombuffer(r["count"], "<i4"))[hit]
                names, count = np.unique(doc, return_counts=True)
                key = own[hit] | (np.uint64(r["frag"]) << np.uint64(40))
                out.append((r["frag"], r["block"], _KNOWN, names.astype("<i4").tobytes(),
                            count.astype("<i4").tobytes(), key.astype("<u8").tobytes()))
    return pa.Table.from_batches([_packed(out)])


def _collect_block(words_percent: int):
    def collect(table: pa.Table) -> pa.Table:
        """One block: every text with its set size, and its shared shingles if they reach the bound."""
        rows = table.to_pylist()
        texts = next(r for r in rows if r["kind"] == _TEXTS)
        head = np.frombuffer(texts["doc"], "<i8").reshape(-1, 4)  # identifier, has one, set size, tag
        doc, key = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for r in rows:
            if r["kind"] == _KNOWN:
                doc.append(np.repeat(np.frombuffer(r["doc"], "<i4"), np.frombuffer(r["count"], "<i4")))
                key.append(np.frombuffer(r["low"], "<u8"))
        doc, key = np.concatenate(doc), np.concatenate(key)
        n = head[:, 2]
        shared = np.bincount(doc, minlength=len(head))
        good = (n > 0) & (100 * shared >= words_percent * n)
        doc, key = doc[good[doc]], key[good[doc]]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order].astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(len(head) + 1))
        sets = pa.array([key[a:b] if g else None for a, b, g in zip(cuts, cuts[1:], good)], pa.list_(pa.int64()))
        row = (np.int64(texts["block"]) << 20) + np.arange(len(head))
        return pa.table({"row": pa.array(row), "id": pa.array(head[:, 0], mask=head[:, 1] == 0),
                         "n": pa.array(n), "shared": sets, "tag": pa.array(head[:, 3])})

    return collect


def _shared_sets(packed: DataFrame, min_percent: int) -> DataFrame:
    """``row, id, n, shared``: ``shared`` is NULL where the bound rules a partner out."""
    answers = packed.groupBy("frag").applyInArrow(_answer, _BLOB)
    return answers.groupBy("block").applyInArrow(
        _collect_block(min_percent), "row bigint, id bigint, n bigint, shared array<bigint>, tag bigint")


class _Blocks:
    """Cuts a task's texts into blocks and packs them."""

    def __init__(self, task: int, fragments: int):
        self.next, self.fragments = task << 16, fragments
        self._clear()

    def _clear(self):
        self.ids, self.sizes, self.tags, self.doc, self.key, self.held = [], [], [], [], [], 0

    def add(self, ids, sizes, tags, doc, key):
        """``key``: fragment in the high bits, 40 bits of hash below."""
        self.doc.append(doc + len(self.ids))
        self.key.append(key)
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        self.tags.extend(tags)
        self.held += len(key)
        if self.held >= BLOCK_SHINGLES or len(self.ids) >= 1 << 18:
            yield self.flush()

    def flush(self):
        head = np.array([[i or 0, i is not None, n, t] for i, n, t in zip(self.ids, self.sizes, self.tags)],
                        "<i8").reshape(-1, 4)
        rows = _deal(self.next, np.concatenate(self.doc), np.concatenate(self.key), self.fragments)
        rows.append((self.next % self.fragments, self.next, _TEXTS, head.tobytes(), b"", b""))
        self.next += 1
        self._clear()
        return _packed(rows)


def _keys(value: np.ndarray, fragments: int) -> np.ndarray:
    frag = (value >> np.uint64(40)) % np.uint64(fragments)
    return (frag << np.uint64(40)) | (value & LOW)


def _pack_texts(docs: DataFrame, fragments: int, words: int, id_col: str, text_col: str) -> DataFrame:
    def pack(batches):
        from pyspark import TaskContext

        blocks = _Blocks(TaskContext.get().partitionId(), fragments)
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                doc, value = shingles(part.column("_text"), words)
                sizes = np.bincount(doc, minlength=part.num_rows).tolist()
                yield from blocks.add(part.column("_id").to_pylist(), sizes, part.column("_tag").to_pylist(),
                                      doc, _keys(value, fragments))
        if blocks.ids:
            yield blocks.flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       _tag(text_col).alias("_tag"))
    return rows.mapInArrow(pack, _BLOB)


def _tag(text_col: str):
    """Tells rows of one identifier apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _pack_sets(sets: DataFrame, fragments: int) -> DataFrame:
    """Like :func:`_pack_texts` for rows ``row, n, shared``; the row number is the identifier."""
    def pack(batches):
        from pyspark import TaskContext

        blocks = _Blocks(TaskContext.get().partitionId(), fragments)
        for batch in batches:
            lists = batch.column("shared")
            key = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ids, sizes = batch.column("row").to_pylist(), batch.column("n").to_pylist()
            for a in range(0, batch.num_rows, 500):
                b = min(a + 500, batch.num_rows)
                doc = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                yield from blocks.add(ids[a:b], sizes[a:b], [0] * (b - a), doc, key[ends[a]:ends[b]])
        if blocks.ids:
            yield blocks.flush()

    return sets.select("row", "n", "shared").mapInArrow(pack, _BLOB)


def _rare_first(sets: DataFrame, min_percent: int) -> DataFrame:
    """Candidate lists ``h, row, n``: the rarest shingles of every set, enough for any link."""
    each = sets.select("row", "n", F.explode("shared").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    need = F.ceil(F.col("n") * min_percent / 100)
    kept = (each.join(often, "h").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"))
            .withColumn("first", (F.size("s") - need + 1).cast("int")).where(F.col("first") > 0))
    return kept.select("row", "n", F.explode(F.slice("s", F.lit(1), F.col("first"))).alias("s")).select("s.h", "row", "n")


def _forest(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links ``left - right`` (indices into ``rows``)."""
    up = np.arange(len(rows))
    while True:  # minimum label over links, with shortcuts
        low = np.minimum(up[left], up[right])
        new = up.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    moved = np.flatnonzero(up != np.arange(len(rows)))
    return list(zip(rows[moved].tolist(), rows[up[moved]].tolist()))


_PARTIAL = "task bigint, component bigint, i int, j int, part int, data binary"


def _overlaps(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, texts: int) -> np.ndarray:
    """Shared keys of every text in ``a`` with every text in ``b``."""
    key, at = np.unique(key, return_inverse=True)
    often = np.bincount(at, minlength=len(key)) > 1        # a shingle of one text here overlaps with nothing
    place = np.cumsum(often) - 1
    doc, at = doc[often[at]], place[at[often[at]]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    out = np.zeros((len(a), len(b)), np.int64)
    spot = np.full(texts, -1)
    for begin in range(0, int(often.sum()), FRAGMENT_COLUMNS):
        low, high = np.searchsorted(at, [begin, begin + FRAGMENT_COLUMNS])
        sides = []
        for own in (a, b):
            spot[:] = -1
            spot[own] = np.arange(len(own))
            rows = spot[doc[low:high]]
            side = np.zeros((len(own), FRAGMENT_COLUMNS), np.float32)
            side[rows[rows >= 0], at[low:high][rows >= 0] - begin] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)    # exact in float32: at most FRAGMENT_COLUMNS
    return out


def _partial(table: pa.Table) -> pa.Table:
    """Overlaps within one vertical part, a packed block for each chunk pair of the task."""
    import zstandard

    table = table.sort_by([(c, "ascending") for c in ("component", "i", "j", "row")]).combine_chunks()
    component, first, second, chunk, n, row = (table.column(c).to_numpy() for c in ("component", "i", "j", "chunk", "n", "row"))
    lists = table.column("own").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    pack = zstandard.ZstdCompressor(level=1).compress
    cuts = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    out = []
    for begin, end in zip(cuts, np.append(cuts[1:], len(row))):
        i, j, part = int(first[begin]), int(second[begin]), table.column("part")[0].as_py()
        own = chunk[begin:end]
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        doc = np.repeat(np.arange(end - begin), np.diff(ends[begin:end + 1]))
        counts = _overlaps(doc, keys[ends[begin]:ends[end]], a, b, end - begin)
        head = np.concatenate([[len(a), len(b)], row[begin:end][a], row[begin:end][b], n[begin:end][a], n[begin:end][b]])
        out.append((table.column("task")[0].as_py(), int(component[begin]), i, j, part,
                    pack(head.astype("<i8").tobytes() + counts.astype("<u4").tobytes())))
    columns = list(zip(*out)) or [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, (
        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["task", "component", "i", "j", "part", "data"])


def _summed(min_percent: int):
    def add(table: pa.Table) -> pa.Table:
        """Links of the chunk pairs of a task: the parts' overlaps summed and compared."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total: dict = {}
        for component, i, j, data in zip(*(table.column(c) for c in ("component", "i", "j", "data"))):
            raw = unpack(data.as_buffer())
            x, y = np.frombuffer(raw, "<i8", 2)
            size = 8 * (2 + 2 * (x + y))
            counts = np.frombuffer(raw, "<u4", x * y, size).reshape(x, y).astype(np.int64)
            key = component.as_py(), i.as_py(), j.as_py()
            if key in total:
                total[key][1] += counts
            else:
                total[key] = [np.frombuffer(raw, "<i8", 2 * (x + y), 16), counts]
        left, right = [], []
        for head, overlap in total.values():
            x, y = overlap.shape
            row_a, row_b, n_a, n_b = np.split(head, np.cumsum([x, y, x]))
            hit = 100 * overlap >= min_percent * (n_a[:, None] + n_b[None, :] - overlap)
            hit &= row_a[:, None] != row_b[None, :]
            a, b = np.nonzero(hit)
            if len(a):
                rows, at = np.unique(np.concatenate([row_a[a], row_b[b]]), return_inverse=True)
                for p, q in _forest(rows, at[:len(a)], at[len(a):]):
                    left.append(p)
                    right.append(q)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return add


def _link_sets(sets: DataFrame, min_percent: int, chunk: int = CHUNK, parts: int = PARTS,
               together: int = TOGETHER) -> DataFrame:
    """``node, component`` of the linked rows among distinct sets ``row, n, shared``."""
    lists = _rare_first(sets, min_percent)
    # texts that share a candidate list, directly or through others; the least row of a list is aggregated before the shuffle
    hubs = lists.groupBy("h").agg(F.min("row").alias("hub"))
    groups = connected_components(lists.join(hubs, "h").select("row", "hub").where(
        F.col("row") != F.col("hub")), "row", "hub")
    group = cut(sets.join(groups.withColumnRenamed("node", "row"), "row"))
    size = cut(group.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1))
    small = F.col("k") <= together // 20
    tasks = max(1, -(-(size.where(small).agg(F.sum("k")).first()[0] or 0) // together))
    size = size.select("component", small.alias("small"), F.ceil(F.col("k") / chunk).cast("int").alias("chunks"))
    dealt = group.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "component", "row", "n", "shared", "chunk", "small", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    task = F.when(F.col("small"), F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(
        F.shiftright(F.xxhash64("component", "i", "j"), 1).bitwiseOR(F.lit(1 << 62)))
    in_part = lambda p: F.filter("shared", lambda h: F.pmod(F.shiftright(h, 8), F.lit(parts)) == p)
    vertical = pairs.withColumn("task", task).select(
        "task", "component", "row", "n", "chunk", "i", "j", F.posexplode(F.array(*[in_part(p) for p in range(parts)])).alias("part", "own"))
    partial = vertical.groupBy("task", "part").applyInArrow(_partial, _PARTIAL)
    links = cut(partial.groupBy("task").applyInArrow(_summed(min_percent), "a bigint, b bigint"))
    return connected_components(links)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     min_percent: int = MIN_PERCENT) -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` of every row, and ``linked, row, tag`` (whether it has
    a link, the operator's own row number, the hash of the text).  ``kept``: the one row that stays of
    its component, the smallest identifier."""
    spark = docs.sparkSession
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TEXTS_PER_FRAGMENT))
    texts = cut(_shared_sets(_pack_texts(docs, fragments, words, id_col, text_col), min_percent))
    possible = texts.where(F.col("shared").isNotNull())
    # equal sets: one representative, the smallest row
    whole = possible.where(F.size("shared") == F.col("n")).withColumn(
        "digest", F.sha2(F.array_join("shared", ",").cast("binary"), 256))
    classes = whole.groupBy("digest", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("k"))
    classes = cut(classes)
    copies = cut(whole.select("row", "digest", "n").join(
        classes.where(F.col("k") > 1), ["digest", "n"]).where(F.col("row") != F.col("rep")).select("row", "rep"))
    reps = possible.select("row", "n", "shared").join(copies.select("row"), "row", "left_anti")
    again = cut(_shared_sets(_pack_sets(reps, fragments), min_percent).where(F.col("shared").isNotNull())
                .select(F.col("id").alias("row"), "n", "shared"))
    parts = _link_sets(again, min_percent)
    # a copy belongs where its representative does
    member = copies.join(parts, copies["rep"] == parts["node"], "left").select(
        "row", F.coalesce("component", "rep").alias("c")).unionByName(
        parts.select(F.col("node").alias("row"), F.col("component").alias("c")))
    alone = copies.select(F.col("rep").alias("row")).distinct().join(
        parts, F.col("row") == F.col("node"), "left_anti").select("row", F.col("row").alias("c"))
    member = cut(member.unionByName(alone))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    names = member.join(texts.select("row", "id"), "row").groupBy("c").agg(first).select(
        "c", F.col("first.id").alias("component_id"), F.col("first.row").alias("stays"))
    labelled = member.join(names, "c").select("row", "component_id", "stays", F.lit(True).alias("linked"))
    linked = F.coalesce("linked", F.lit(False))
    return texts.select("row", "id", "n", "tag").join(labelled, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        (~linked | (F.col("stays") == F.col("row"))).alias("kept"), linked.alias("linked"), "row", "tag")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row of each component of ``docs``, all columns unchanged."""
    found = ngram_components(docs, id_col, text_col, words, min_percent).where("linked")
    names = found.groupBy(F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col), F.lit(0)).alias("_id"),
                          F.col("tag").alias("_tag")).agg(F.max("kept").alias("_stays"))
    on = ["_none", "_id", "_tag"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col), F.lit(0)).alias("_id"),
                       _tag(text_col).alias("_tag"))
    stay = rows.join(names, on, "left").where(F.coalesce("_stays", F.lit(True)))
    # equal rows of a linked text are one; rows without a link are left as they are
    number = F.row_number().over(Window.partitionBy(*on).orderBy("_id"))
    return stay.withColumn("_number", number).where(F.col("_stays").isNull() | (F.col("_number") == 1)).select("_row.*")
