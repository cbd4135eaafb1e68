"""Removal of repeated passages against comparison of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.llm.suffix_index import RUN, SuffixIndex, anchors, remove_repeats

SCHEMA = "doc_id bigint, text string, _doc int, dest string, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def brute(rows, length):
    """(id, bytes, spans, kept) of every row."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    keys = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0], sha(r[1])))
    seen, result = set(), {}
    for i, t in keys:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(window)
        edges = np.flatnonzero(np.diff([0, *gone, 0])).tolist()
        result[i, t] = (len(raw), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(raw, gone) if not g))
    return sorted(((i, *result[i, t or ""]) for i, t in rows), key=str)


def got(df):
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in df.collect()), key=str)


def corpus(seed, n):
    """Texts with copies, shared passages, runs of one character and edits."""
    draw = random.Random(seed)
    letters = "abcdefgh é"
    passages = ["".join(draw.choices(letters, k=draw.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = draw.random()
        if kind < 0.15 and rows:
            text = draw.choice(rows)[1]
        elif kind < 0.3 and rows:
            text = list(draw.choice(rows)[1] or "x")
            for _ in range(draw.randint(1, 3)):
                text[draw.randrange(len(text))] = draw.choice(letters)
            text = "".join(text)
        elif kind < 0.35:
            text = draw.choice("ab") * draw.randint(0, 80)
        else:
            parts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3)]
            text = draw.choice(passages).join(parts)
        rows.append((i * 3 + 1, text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, length, batches, options", [
    (1, 12, 4, {}), (2, 8, 1, {"chunk": 37}), (3, 20, 7, {"wide": 1, "fragments": 3}), (4, 9, 3, {"flush": 1, "wide": 2})])
def test_against_all_windows(spark, seed, length, batches, options):
    rows = corpus(seed, 120)
    assert got(remove_repeats(frame(spark, rows), length=length, batches=batches, **options)) == brute(rows, length)


def test_nulls_repeated_rows_and_long_texts(spark):
    long = "".join(random.Random(5).choices("abc", k=3000))
    rows = [(None, "a passage that is shared"), (4, "a passage that is shared!"), (4, None), (4, "a passage that is shared!"),
            (2, ""), (3, long), (9, long[1000:2500] + "x" + long), (None, None), (1, "é" * 20)]
    assert got(remove_repeats(frame(spark, rows), length=10, chunk=64)) == brute(rows, 10)


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, ""), (2, "short")]):
        assert got(remove_repeats(frame(spark, rows), length=10)) == brute(rows, 10)


def test_equal_windows_have_equal_anchors():
    draw = random.Random(9)
    data = np.frombuffer("".join(draw.choices("ab", k=2000)).encode(), np.uint8)
    length, at = 16, {}
    for h, _, owner, start, size in anchors(data, np.array([0, 700, 2000]), length, 101):
        for a, o, s, n in zip(h, owner, start, size):
            for p in range(s, s + n - length + 1):
                at[o * 700 + p] = a
    assert len(at) == 2000 - 2 * (length - 1)
    by = {}
    for p, a in at.items():
        assert by.setdefault(bytes(data[p:p + length]), a) == a


def test_levels_merge_geometrically(spark):
    docs = frame(spark, corpus(11, 80)).select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    index = SuffixIndex(fragments=4, length=12)
    sizes = []
    for k in range(7):
        index.add(docs.where((F.col("_doc") > 35 * k) & (F.col("_doc") <= 35 * (k + 1))))
        sizes.append([s for s, _, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    for _, number, rows in index.levels:  # a fragment of a level is one sorted run
        assert {r["level"] for r in rows.collect()} == {number}
        assert rows.where(F.col("kind") == RUN).groupBy("dest").count().where("count > 1").count() == 0


def test_query_on_the_table(spark, sf_dir):
    from tabrisk.llm.queries import QUERIES

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op12_suffix_array_dedup"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(rows, 100)}
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
    assert sum(v[1] for v in want.values()) > 0
