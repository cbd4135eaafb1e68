"""Exact and near copies of texts and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabrisk.llm import ngram_join
from tabrisk.llm.components import connected_components
from tabrisk.llm.embeddings import learn_rotations, near_duplicates, tables_for
from tabrisk.llm.exact_dedup import drop_copies, exact_dedup
from tabrisk.llm.ngram_join import drop_near_copies, ngram_components

SCHEMA = "doc_id bigint, text string, _run int, keep_id string, row string, n int"


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in rows], SCHEMA)


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- exact copies ----

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\n b"), (1, " a b"), (2, None), (4, ""), (6, " "), (7, "A b"),
        (8, "a b"), (10, "x" * 200_000), (11, "x" * 200_000), (3, "a b"), (None, "a b"), (None, "only")]


def test_exact_dedup_brute_force(spark):
    norm = [(i, re.sub("[\x20\x09-\x0D]+", " ", t or "")) for i, t in ROWS]
    want = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup(frame(spark, ROWS)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    docs = frame(spark, ROWS)
    got = drop_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert kept == sorted([(False, 3), (False, 1), (False, 2), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)])


@pytest.mark.parametrize("operator", [exact_dedup, drop_copies, ngram_components, drop_near_copies])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_exact_dedup_is_native(spark, sf_dir):
    plan = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- components ----

def test_connected_components_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 260)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(300, 330)]
        groups = Groups(range(400))
        for a, b in links:
            groups.join(a, b)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: groups.find(x) for x in touched}


# ---- n-gram join ----

def shingle_sets(rows, words=5):
    out = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words
                   else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    groups = Groups(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(groups.find(k), []).append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    return [(rows[k][0], len(sets[k]), least[groups.find(k)]) for k in range(len(rows))]


def near_copies(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return words


def corpus():
    rng = random.Random(3)
    word = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(word) for _ in range(40)]
    for g in range(25):
        base = [rng.choice(word) for _ in range(rng.randrange(30, 160))]
        if g % 3 == 0:
            base = base[:20] + passage + base[20:]     # shared by many texts
        for e in (0, 1, 1, 2, 3, 5):
            rows.append(" ".join(near_copies(rng, base, e)))
    big = [rng.choice(word) for _ in range(120)]
    rows += [" ".join(near_copies(rng, big, 2)) for _ in range(60)]   # a large group of near copies
    rows += [" ".join(big)] * 20                                       # and of exact ones
    chain = [rng.choice(word) for _ in range(100)]
    for k in range(12):                                                # each links with the next only
        chain = chain[4:] + [f"c{k}_{j}" for j in range(4)]
        rows.append(" ".join(chain))
    rows += ["one two", "One  TWO", "two one", "", " \n", "a b c d e", "A b c d E", "a b c d e f"]
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows)) + [(None, None), (None, rows[0]), (ids[5], rows[5])]


@pytest.fixture(scope="module")
def near_rows():
    return corpus()


def test_ngram_components_brute_force(spark, near_rows):
    docs = frame(spark, near_rows).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_components(near_rows), key=key)


def test_drop_near_copies_keeps_one_of_each_group(spark, near_rows):
    docs = frame(spark, near_rows)
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    want = {c for _, n, c in brute_components(near_rows) if n}
    kept = [r.doc_id for r in got.collect() if shingle_sets([(r.doc_id, r.text)])[0]]
    assert sorted(kept) == sorted(want)
    empty = sum(1 for _, t in near_rows if not (t or "").strip())
    assert got.count() == len(want) + empty


def test_threshold_is_compared_in_integers(spark):
    # 8 of 10 shingles shared: exactly 80 %
    a = [f"w{i}" for i in range(13)]                     # 9 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a + ["z"])), (3, " ".join(a[:-1])), (4, " ".join(a[:-3]))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows))


# ---- embeddings ----

def planted(seed=0, dims=64):
    """Vectors with neighbours at given cosines, tight clusters, copies and bad rows."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows, vec = [], []
    for _ in range(300):
        base = unit(rng.standard_normal(dims))
        vec.append(base)
        for cosine in (0.931, 0.935, 0.95, 0.9, 0.929):
            other = rng.standard_normal(dims)
            other = unit(other - (other @ base) * base)
            vec.append(cosine * base + np.sqrt(1 - cosine ** 2) * other)
    centre = unit(rng.standard_normal(dims))
    vec += [unit(centre + 0.02 * rng.standard_normal(dims)) for _ in range(150)] + [centre] * 30
    for i, v in enumerate(vec):
        rows.append((i * 3, (i // 7) % 4, [float(np.float32(x)) for x in v]))
    rows += [(1, 0, None), (4, 0, [0.0] * dims), (7, 0, [float("nan")] + [1.0] * (dims - 1)),
             (10, 0, [None] + [1.0] * (dims - 1)), (13, None, rows[0][2]), (16, 0, [1.0, 0.0]), (19, 0, [2.0, 0.0]),
             (None, 0, [5.0, 0.0]), (22, 0, [float("inf")] + [1.0] * (dims - 1)), (25, 0, []), (28, 1, [1e-200, 0.0]),
             (31, 1, [1e200, 0.0])]
    return rows


def brute_links(rows):
    good = [k for k, (i, l, v) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v)
            and any(v)]
    n, groups = [0] * len(rows), Groups(range(len(rows)))
    for length in {len(rows[k][2]) for k in good}:
        for label in {rows[k][1] for k in good}:
            own = [k for k in good if rows[k][1] == label and len(rows[k][2]) == length]
            if not own:
                continue
            x = np.array([rows[k][2] for k in own], float)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            s = x @ x.T >= 0.93
            np.fill_diagonal(s, False)
            for a, b in zip(*np.nonzero(s)):
                n[own[a]] += 1
                groups.join(own[a], own[b])
    return n, groups


def test_near_duplicates_recall_and_precision(spark):
    rows = planted()
    n, groups = brute_links(rows)
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                    "vec_id bigint, label int, embedding array<double>, code string, entry int")
    got = {(r.vec_id, r.n_links) for r in near_duplicates(vectors, chunk=40).select("vec_id", "n_links").collect()}
    want = {(i, k) for (i, _, _), k in zip(rows, n)}
    found = {i: k for i, k in got}
    assert len(got) == len(rows)
    assert all(found[i] <= k for i, k in want)                        # never a link below the threshold
    assert sum(found.values()) >= 0.98 * sum(k for _, k in want)      # measured recall, many pairs at the threshold
    cluster = [i for (i, l, v), k in zip(rows, n) if k > 20]
    assert all(found[i] == dict(want)[i] for i in cluster)            # far above it nothing is missed


def test_near_duplicates_bad_rows_and_components(spark):
    rows = planted()[-60:]
    n, groups = brute_links(rows)
    vectors = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    members = {}
    for k, (i, _, _) in enumerate(rows):
        members.setdefault(groups.find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    want = {(i, n[k], least[groups.find(k)], i == least[groups.find(k)]) for k, (i, _, _) in enumerate(rows)}
    assert {tuple(r) for r in near_duplicates(vectors).collect()} == want
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_rotation_is_orthogonal_and_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)) @ rng.standard_normal((16, 16))
    turn = learn_rotations(x, 16)
    assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8)
    share = (x @ turn >= 0).mean(0)
    assert (abs(share - 0.5) < 0.15).all()


def test_tables_follow_the_size():
    assert tables_for(10)[0] == 4
    assert tables_for(10 ** 6)[0] == 14
    assert tables_for(10 ** 6)[1] > tables_for(10 ** 4)[1]


def test_threshold_is_exact_for_millions_of_shared_shingles(monkeypatch):
    """A pair exactly at 80 %, where 100 times the overlap is no float32."""
    monkeypatch.setattr(ngram_join, "FRAGMENT_COLUMNS", 1 << 20)  # few turns
    m = 671089
    common, n = 4 * m, (3019900, 3019901)
    lists = [np.concatenate([np.arange(common), np.arange(common, k) + (i << 32)]) for i, k in enumerate(n)]
    assert 100 * common == 80 * (sum(n) - common)
    halves = []
    for part in range(2):
        own = [x[x % 2 == part] for x in lists]
        table = pa.table({"task": [5, 5], "component": [3, 3], "i": [0, 0], "j": [0, 0], "part": [part, part], "chunk": [0, 0],
                          "n": list(n), "row": [3, 7], "own": pa.ListArray.from_arrays(
                              np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate(own))})
        halves.append(ngram_join._partial(table))
    assert len(ngram_join._summed(80)(pa.concat_tables(halves))) == 1
    assert len(ngram_join._summed(81)(pa.concat_tables(halves))) == 0


@pytest.mark.parametrize("chunk, parts, together", [(3, 1, 1), (5, 3, 40), (1000, 4, 2000)])
def test_links_whatever_the_chunks_and_parts(spark, near_rows, chunk, parts, together):
    """Sets as rows: the linked rows and their components do not depend on the cuts."""
    rng = random.Random(4)
    base = [rng.sample(range(10 ** 6), 40) for _ in range(12)]
    sets = [sorted(set(rng.choice(base)[: rng.randint(34, 40)]) | {rng.randrange(10 ** 6) for _ in range(rng.randint(0, 5))}) for _ in range(90)]
    sets = [list(x) for x in {tuple(s) for s in sets}]
    groups = Groups(range(len(sets)))
    linked = set()
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(set(x) & set(sets[j]))
            if 100 * o >= 80 * (len(x) + len(sets[j]) - o):
                groups.join(i, j)
                linked |= {i, j}
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "row bigint, n bigint, shared array<bigint>")
    got = {r.node: r.component for r in ngram_join._link_sets(df, 80, chunk, parts, together).collect()}
    assert got == {i: groups.find(i) for i in linked} and len(linked) > 20
