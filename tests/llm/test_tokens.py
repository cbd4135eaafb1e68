"""Sub-word ids, token files, token counts and packing against the library and brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tabrisk.llm import packing, token_files
from tabrisk.llm.pieces import cut_pieces, text_slices
from tabrisk.llm.token_counts import token_counts
from tabrisk.llm.tokens import TextEncoder, encoder, vocabulary

VOCABULARY = vocabulary()
STRANGE = ["", " a  b", "don't stop... the é́x y z w  'Tis", "<|endoftext|> x<|endoftext|>y", "İstanbul ﬁ Ǆ H̱ ẗ",
           "a\x1cb \x85 c d", "≠ .̸ ̸x", "日本語 テキスト 한국어", "👩‍👩‍👧 ok", "word " * 3000, "x" * 5000, "\n\n\n", "A.B,C!! 12345"]


def library(texts):
    return [e.ids for e in encoder(VOCABULARY).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_texts_have_the_librarys_ids_and_spans():
    enc = TextEncoder(VOCABULARY)
    ids, bounds, spans = enc.encode(pa.array([*STRANGE, None]), spans=True)
    for t, a, b in zip([*STRANGE, ""], bounds, bounds[1:]):
        want = enc.tokenizer.encode(t, add_special_tokens=False)
        assert ids[a:b].tolist() == want.ids
        assert [tuple(s) for s in spans[a:b]] == want.offsets
    assert TextEncoder(VOCABULARY, special_as_text=True).check_splits(STRANGE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_has_the_librarys_ids(texts):
    assert encoder(VOCABULARY).check_splits(texts)


def test_memory_of_pieces_is_bounded_and_harmless():
    enc = TextEncoder(VOCABULARY, remember=50)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(1, 30)]
    for t in texts:
        ids, bounds = enc.encode(pa.array([t]))
        assert ids.tolist() == library([t])[0]
        assert enc.memory.start.size <= 50


def test_pieces_and_slices():
    batch = pa.RecordBatch.from_pydict({"t": ["ab c", None, "  ", "d" * 100, "e\tf"], "n": [1, 2, 3, 4, 5]})
    assert [part.column("n").to_pylist() for part in text_slices(batch.slice(1), "t", 3)] == [[2, 3], [4], [5]]
    own = cut_pieces(batch.column("t"))
    assert own.words.take(pa.array(own.index)).to_pylist() == ["ab", "c", "d" * 100, "e", "f"]
    assert own.first.tolist() == [0, 2, 2, 2, 3, 5]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                                 "doc_id bigint, text string, item bigint, content string")


ROWS = [(i * 7 % 101, t) for i, t in enumerate(STRANGE)] + [(None, "no id"), (3, None), (3, "again"), (3, "again"), (-5, "neg")]


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(documents(spark, ROWS).repartition(3), path, VOCABULARY, 2, file_bytes=300)
    got = token_files.read_token_files(spark, path).collect()
    want = sorted((i is not None, i or 0, [*ids, 2]) for (i, _), ids in zip(ROWS, library([t for _, t in ROWS])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == want
    # ascending identifiers over the files, positions without gaps
    places = sorted(got, key=lambda r: (r.task, r.number, r.position))
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in places]
    assert keys == sorted(keys)
    first = {(r.task, r.number): r.first_token for r in token_files.file_totals(spark, path).collect()}
    at = 0
    for r in places:
        assert first[r.task, r.number] + r.local_start == at
        at += r.n_tokens
    some = token_files.read_token_files(spark, path, only=[3, 7]).collect()
    assert sorted(r.doc_id for r in some) == sorted(i for i, _ in ROWS if i in (3, 7))


def test_token_files_are_plain_zstandard_and_checked(spark, tmp_path):
    path = tmp_path / "files"
    token_files.write_token_files(documents(spark, ROWS), str(path), VOCABULARY, 2)
    files = [f.read_bytes() for f in path.glob("part-*")]
    content = max(files, key=len)
    entries, at, width, _, _ = token_files.read_table(content)
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert len(whole) == entries["size"].sum()
    unpack = zstandard.ZstdDecompressor()
    big = int(np.argmax(entries["packed"]))
    token_files.read_frame(content, entries, at, big, width, unpack)
    damaged = bytearray(content)
    damaged[at[big + 1] - 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.read_frame(bytes(damaged), entries, at, big, width, unpack)
    with pytest.raises(ValueError):
        token_files.read_table(content[:-1] + b"x")


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    out = token_files.token_file_digest(documents(spark, []), VOCABULARY, 2, path)
    assert out.count() == 0


def test_token_digest(spark):
    rows = [(i, t) for i, t in enumerate(STRANGE)]
    got = token_files.token_file_digest(documents(spark, rows), VOCABULARY, 2).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, library(STRANGE), strict=True):
        own = np.array([*ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


# ---- token counts ----

def brute_counts(text, sections, rule):
    e = encoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False)
    counts, crossing, lost = [0] * len(sections), [0] * len(sections), 0
    for a, b in e.offsets:
        over = [(k, min(b, t) - max(a, s)) for k, (s, t) in enumerate(sections) if min(b, t) > max(a, s)]
        if not over:
            lost += 1
            continue
        k = over[0][0] if rule == "start" else over[-1][0] if rule == "end" else max(over, key=lambda x: (x[1], -x[0]))[0]
        counts[k] += 1
        crossing[k] += len(over) > 1
    return counts, crossing, lost


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_line_sections_brute_force(spark, rule):
    texts = ["one line", "first\nsecond line here\n\nfourth", "", None, "abcdefghijklmnop " * 9, "\n", "é́x\nü" * 20]
    rows = list(enumerate(texts))
    got = token_counts(documents(spark, rows), VOCABULARY, rule, max_chars=7).orderBy("doc_id", "section").collect()
    want = []
    for i, t in rows:
        sections, at = [], 0
        for line in (t or "").splitlines(keepends=True) if t else []:
            for k in range(0, len(line), 7):
                sections.append((at + k, at + min(k + 7, len(line))))
            at += len(line)
        sections = sections or [(0, 0)]
        counts, crossing, lost = brute_counts(t, sections, rule)
        assert not lost
        want += [(i, k, s, e, c, x) for k, ((s, e), c, x) in enumerate(zip(sections, counts, crossing))]
    assert [tuple(r) for r in got] == want
    assert sum(r.n_crossing for r in got) > 0


def test_given_spans(spark):
    text = "hello wonderful world"
    rows = [(1, text, [(0, 7), (7, 12)]), (2, text, None), (3, None, [(0, 3)]), (4, text, [(5, 2), None, (12, 21)]), (5, text, [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<start:int,end:int>>")
    got = {}
    for r in token_counts(docs, VOCABULARY, "majority", spans_col="spans").collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    n = len(library([text])[0])
    counts, _, lost = brute_counts(text, [(0, 7), (7, 12)], "majority")
    assert got[1] == {0: counts[0], 1: counts[1], **({-1: lost} if lost else {})}
    assert got[2] == {-1: n} and got[3] == {0: 0} and got[5] == {-1: n}
    assert sum(got[4].values()) == n
    with pytest.raises(ValueError):
        token_counts(docs, VOCABULARY, "nearest")
    assert token_counts(docs.limit(0), VOCABULARY).count() == 0


# ---- packing ----

def valid(lengths, assign, capacity):
    return (np.bincount(assign, weights=lengths) <= capacity).all() and (assign >= 0).all()


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 400, 300)
    a, b = packing.greedy(lengths, 1000), packing.greedy(lengths, 1000, rng, 0.3)
    for _ in range(20):
        child = packing.crossover(lengths, a, b, 1000, rng)
        assert valid(lengths, child, 1000) and len(child) == len(lengths)
        assert set(np.unique(child)) == set(range(child.max() + 1))
        a, b = b, child
    best = packing.evolve(lengths, 1000, [], rng)
    scores = [packing.fitness(lengths, x, 1000) for x in best]
    assert scores == sorted(scores, reverse=True)
    assert scores[0] >= packing.fitness(lengths, packing.greedy(lengths, 1000), 1000)


def test_genetic_search_beats_best_fit_on_triplets():
    """Triplets that fill a bin exactly: best fit decreasing wastes bins."""
    rng = np.random.default_rng(0)
    items = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, 1000 - a - 250))
        items += [a, b, 1000 - a - b]
    lengths = rng.permutation(np.array(items))
    greedy = packing.greedy(lengths, 1000).max() + 1
    best = packing.evolve(lengths, 1000, [], rng, children=300)[0].max() + 1
    assert best < greedy


def test_pack_levels_reach_the_bound(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.exponential(300, 900).astype(int), 999)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item bigint, length bigint")
    got = packing.pack(items, 1000, shard_items=100).toPandas().set_index("item").sort_index()
    assert got.index.tolist() == list(range(900))
    got["length"] = lengths
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values(["offset", "length"])
        assert own["length"].sum() <= 1000
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all()
    least = -(-int(lengths.sum()) // 1000)
    assert got["sequence_id"].nunique() <= least * 1.02 + 1
    assert packing.pack(items.limit(0), 1000).count() == 0


@pytest.mark.parametrize("lengths, capacity, most", [
    (np.random.default_rng(2).integers(1400, 2001, 300), 4096, 155),  # two a bin, none is filled
    (np.ones(300, int), 100, 5),                                      # a shard does not fill a bin
    (np.random.default_rng(3).integers(2049, 4013, 200), 4096, 200)])
def test_pack_keeps_shards_bounded(spark, monkeypatch, lengths, capacity, most):
    """Lengths that cannot be packed to LOW_FILL do not end in one shard."""
    sizes, evolve = [], packing._evolve_shards

    def measured(items, *rest):
        sizes.extend(r["count"] for r in items.groupBy("_shard").count().collect())
        return evolve(items, *rest)

    monkeypatch.setattr(packing, "_evolve_shards", measured)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item bigint, length bigint")
    got = packing.pack(items, capacity, shard_items=40).toPandas().set_index("item").sort_index()
    assert max(sizes) <= 80
    assert got.index.tolist() == list(range(len(lengths)))
    got["length"] = lengths
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= capacity
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all()
    assert got["sequence_id"].nunique() <= most


def test_pack_documents_pieces(spark):
    rows = ROWS + [(500, "word " * 9000)]
    got = packing.pack_documents(documents(spark, rows), VOCABULARY, 1, 512).toPandas()
    want = []
    for (i, _), ids in zip(rows, library([t for _, t in rows])):
        ids = [*ids, 1]
        for n, a in enumerate(range(0, len(ids), 512)):
            own = np.array(ids[a:a + 512], "<u4")
            want.append((i, n, a, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: tuple(map(str, r))
    rows_got = [(None if i != i else int(i), *r) for i, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows_got, key=key) == sorted(want, key=key)
    assert (got.groupby("sequence_id")["length"].sum() <= 512).all()
    assert packing.pack_documents(documents(spark, []), VOCABULARY, 1).count() == 0


def test_remembered_pieces_of_one_hash(monkeypatch):
    from tabrisk.llm import tokens
    monkeypatch.setattr(tokens, "_hashes", lambda data, start, length: length.astype(np.uint64) % np.uint64(3))
    enc = TextEncoder(VOCABULARY)
    for texts in (["one two three", "a bb ccc dddd"], ["two one", "bb a eeee three three"], ["one", "", "x" * 200]) * 2:
        ids, bounds, spans = enc.encode(pa.array(texts), spans=True)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library(texts)
    assert enc.memory.start.size <= 3
