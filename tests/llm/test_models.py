"""Language, quality, mixing and language-model operators: brute force or held-out quality."""

import itertools
import math
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabrisk.llm import context_tree, language, mixing, quality
from tabrisk.llm.pieces import give_back
from tabrisk.llm.shared import crc_mod, labelled_sample

BIG = "/root/testdata/sf0.01"


def documents(spark, rows, more="_lang string, score int, _row int, p0 int"):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, " + more)


# ---- language ----

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = language.fit_language(docs, crc_mod("doc_id", 5) != 0)
    out = language.predict_language(docs, model).where(crc_mod("doc_id", 5) == 0)
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97


def test_language_kernel_against_sets():
    """Scores equal kernel ridge regression worked out with Python sets."""
    texts = ["the cat", "le chat", "The  Cat!", "das tier", "", "12 34"]
    doc, gram, has = language.grams(pa.array(texts))
    sets = [set(gram[doc == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[2] and has.tolist() == [True, True, True, True, False, False]
    low = " ".join(re.findall("[a-z]+", texts[0]))
    plain = {low[i:i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)} - {" "}
    assert len(sets[0]) >= len(plain)  # and the boundaries after the text


def test_language_edges(spark):
    rows = [(1, "hello there my friend how are you", "en"), (2, "bonjour mon ami comment allez vous", "fr"),
            (3, None, "en"), (4, "", None), (5, "1234 !!", "fr"), (None, "hello friend", None), (6, "hello friend", None)]
    docs = documents(spark, rows)
    model = language.fit_language(docs, F.lit(True))
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict_language(
        docs.select("doc_id", "text"), model).collect()}
    assert got[6, "hello friend"] == got[None, "hello friend"]
    assert got[6, "hello friend"][0] == "en" and 0.5 < got[6, "hello friend"][1] <= 1
    for key in ((3, None), (4, ""), (5, "1234 !!")):
        assert got[key] == ("und", 0.0)
    assert language.fit_language(docs, F.lit(False)) is None
    none = language.predict_language(docs.select("doc_id", "text"), None)
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.predict_language(docs.limit(0).select("text"), model).count() == 0
    kept = language.keep_identified(docs, F.lit(True))
    assert kept.columns == docs.columns and kept.count() == 4


def test_language_sample_with_many_copies(spark):
    """A text with thousands of copies is one row of the sample; the others are learnt too."""
    rows = [(i, "hello there my friend how are you", "en") for i in range(500)]
    rows += [(1000, "bonjour mon ami comment allez vous", "fr"), (1001, "guten tag mein freund wie geht es", "de")]
    docs = documents(spark, rows).coalesce(1)
    got = language._sample(docs, "lang", "text", F.lit(True), 6).collect()
    assert sorted((r["lang"], r["rank"]) for r in got) == [("de", 1), ("en", 1), ("fr", 1)]
    model = language.fit_language(docs, F.lit(True), sample=6)
    assert model.languages == ["de", "en", "fr"]
    out = language.predict_language(docs, model).select("lang", "lang_pred").distinct().collect()
    assert sorted(tuple(r) for r in out) == [("de", "de"), ("en", "en"), ("fr", "fr")]


def test_language_workers_get_texts_once(spark):
    """A string text travels inside its row only; any other type, beside it as a string."""
    docs = documents(spark, [(1, "hello there", "en"), (2, None, "en"), (3, "", "en"), (4, "bonjour a vous", "fr")])
    model = language.fit_language(docs, F.lit(True))
    one = language._predicted(docs, model, "text")
    assert "_text" not in one._jdf.queryExecution().analyzed().toString()
    assert {r["_row"].doc_id: r["_lang"] for r in one.collect()} == {1: "en", 2: "und", 3: "und", 4: "fr"}
    codes = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    assert {r.doc_id: r.lang_pred for r in language.predict_language(codes, model).collect()} == {
        1: "en", 2: "und", 3: "und", 4: "fr"}


def test_language_slices_need_little_memory():
    """A worker's arrays stay small on a batch of many texts."""
    texts = pa.array(["some words of a plain text, again and again. " * 60] * 1500)  # 4 MB
    gram = np.unique(language.grams(texts.slice(0, 1))[1])
    model = language.LanguageModel(["en"], gram, np.ones((len(gram), 1), np.float32), np.ones((1, 1), np.float32), np.zeros(1, np.float32))
    lookup = np.full(language.GRAMS, -1, np.int32)
    lookup[gram] = np.arange(len(gram))
    language.grams(texts.slice(0, 1))
    tracemalloc.start()
    for part in language.text_slices(pa.RecordBatch.from_arrays([texts], ["_text"]), "_text", language.SLICE):
        assert model.predict(part.column("_text"), lookup)[0] == ["en"] * part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak


def test_freed_memory_goes_back():
    """What a task has freed between things that stay is not held by its worker."""
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    many = [np.ones(8000) for _ in range(1500)]  # 96 MB
    many = many[::50]
    before = resident()
    give_back()
    assert before - resident() > 40e6
    assert len(many) == 30


def test_language_keeps_short_texts_of_many_languages(spark):
    """Every lettered text of a learned language stays, whatever its length and the number of languages."""
    words = ["hello", "bonjour", "guten", "hola", "ciao", "merhaba", "ahoj", "szia", "tere", "labas"]
    rows = [(10 * i + j, f"{w} {x}", f"l{i}") for i, w in enumerate(words) for j, x in enumerate(("a", "b"))]
    short = [(1000 + i, t, f"l{i % 10}") for i, t in enumerate(["Avec.", "De.", "x", "q!", "Die tz.", "o"])]
    docs = documents(spark, rows + short + [(2000, "12 !", "l0"), (2001, None, "l0")])
    kept = {r.doc_id for r in language.keep_identified(docs, F.col("doc_id") < 1000).collect()}
    assert kept == {r[0] for r in rows + short}


def test_labelled_sample_with_many_copies(spark):
    """One row a drawn identifier, so repetitions cut neither the other documents nor a class."""
    rows = [(1, "The same good text.", 1)] * 500 + [(2, "Other\nlines", 0), (2, "Another text", 0), (3, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").coalesce(1)
    got = labelled_sample(docs, docs, "doc_id", "text", "quality", 2, 1 << 20).collect()
    assert sorted((r["_y"], r["_key"], r["_text"]) for r in got) == [
        (0, 2, "Another text"), (1, 1, "The same good text."), (1, 3, "x y z")]
    assert quality.fit_quality(docs, docs, sample=4) is not None
    labels = docs.select("doc_id", F.col("quality").cast("string").alias("domain"))
    assert mixing.fit_domains(docs, labels, ["0", "1"], sample=4).bias.shape == (2,)


# ---- quality ----

def enumerate_marginals(emit, change, begin):
    n = len(emit)
    weight = {}
    for labels in itertools.product((0, 1), repeat=n):
        s = sum(e for e, y in zip(emit, labels) if y) + (begin if labels[0] else 0)
        s += sum(change[a, b] for a, b in zip(labels, labels[1:]))
        weight[labels] = math.exp(s)
    z = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[t]) / z for t in range(n)]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 5, 3, 8, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit, change, begin = rng.standard_normal(first[-1]) * 2, rng.standard_normal((2, 2)), 0.7
    ahead, behind = quality.forward_backward(emit, first, change, begin)
    got = 1 / (1 + np.exp(-(ahead + behind)))
    for a, b in zip(first, first[1:]):
        assert np.allclose(got[a:b], enumerate_marginals(emit[a:b], change, begin))


def test_line_features():
    texts = pa.array(["One two\nTWO two two\n", None, "", "a\n\nb\na", "x"])
    x, size, first = quality.line_features(texts)
    assert np.diff(first).tolist() == [3, 1, 1, 4, 1]
    assert size.tolist() == [8, 12, 0, 0, 0, 2, 1, 2, 1, 1]
    alone, _, _ = quality.line_features(pa.array(["a\n\nb\na"]))
    assert np.allclose(alone, x[5:9])  # features do not see other texts


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    both = docs.select("doc_id", "text").join(labels, "doc_id")
    model = quality.fit_quality(docs, labels.where(crc_mod("doc_id", 3) != 1))
    held = both.where(crc_mod("doc_id", 3) == 1)
    got = quality.score_quality(held, model).join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert ((got.score >= 0.5).astype(int) == got.quality).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "ok text", 1), (2, None, 0), (None, "", None), (3, "A\n" * 5000, 1), (3, "A\n" * 5000, 1)],
                                 "doc_id bigint, text string, quality int")
    assert quality.fit_quality(docs, docs.where("quality = 1")) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    model = quality.fit_quality(docs, docs)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert len({round(r.score, 9) for r in got if r.doc_id in (2, None)}) == 1
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_letters_above_the_second_plane_only(spark):
    for text, has in (("\U000F0000", False), ("\U000E0100", False), ("123 \U000E0041", False), ("\U00030000", True), ("\U00020000", True)):
        assert language.grams(pa.array([text]))[2].tolist() == [has], text


def test_unlabelled_tables_keep_texts_with_a_letter(spark):
    rows = [(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = language.keep_identified(docs, F.lit(True))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
    named = docs.unionByName(spark.createDataFrame([(9, "some more words", "en")], docs.schema))
    assert {r.doc_id: r.lang for r in language.keep_identified(named, F.lit(True)).collect()} == {1: "en", 4: "en", 9: "en"}


# ---- mixing ----

def members(spark, n=400, k=3, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.2] * k, n)
    t = rng.integers(1, 500, n)
    rows = [(i, int(t[i]), *map(float, p[i]), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, " + ", ".join(f"p{j} double" for j in range(k)) + ", _u double"), t, p


def test_rates_solve_the_least_squares_problem(spark):
    frame, t, p = members(spark)
    targets, ridge = [0.5, 0.2, 0.5], 1e-2
    got = mixing.fit_rates(frame, targets, ridge=ridge, steps=300, tolerance=1e-10).orderBy("doc_id").toPandas()
    r, s = got.rate.to_numpy(), t / t.sum()
    share = (s[:, None] * p).sum(0)
    # the same problem by plain projected gradient in numpy
    x = np.ones(len(t))
    for _ in range(5000):
        residual = ((x * s)[:, None] * p).sum(0) - targets
        x = np.maximum(0, x - (p @ (residual / share) + ridge * (x - 1)) / (1 + ridge))
    assert np.allclose(r, x, atol=1e-3)
    assert (r >= 0).all()
    assert np.allclose(((r * s)[:, None] * p).sum(0), targets, atol=0.02)


def test_rates_converge_with_soft_posteriors(spark):
    """Production settings, calibrated posteriors that are right in about three of four cases."""
    rng = np.random.default_rng(3)
    now, targets = np.array([0.6, 0.25, 0.15]), np.array([0.90, 0.07, 0.03])
    y = rng.choice(3, 600, p=now)
    x = np.eye(3)[y] + 0.8 * rng.standard_normal((600, 3))
    p = now * np.exp(x / 0.64)
    p /= p.sum(1, keepdims=True)
    t = rng.integers(1, 500, 600)
    frame = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p)],
                                  "n_tokens bigint, p0 double, p1 double, p2 double")
    got = mixing.fit_rates(frame, list(targets)).toPandas()
    q = got[["p0", "p1", "p2"]].to_numpy()
    s = got.n_tokens.to_numpy() / t.sum()
    share, r = (s[:, None] * q).sum(0), np.ones(600)
    for _ in range(30000):
        r = np.maximum(0, r - (q @ (((s * r) @ q - targets) / share) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE))
    assert np.allclose((s * got.rate.to_numpy()) @ q, (s * r) @ q, atol=1e-4)
    assert got.residual.max() < mixing.TOLERANCE < mixing.fit_rates(frame, list(targets), steps=2).first()["residual"]


def test_rates_edges(spark):
    frame, _, _ = members(spark, 5)
    assert mixing.fit_rates(frame.limit(0), [0.5, 0.3, 0.2]).count() == 0
    zero = mixing.fit_rates(frame.withColumn("n_tokens", F.lit(0)), [0.5, 0.3, 0.2]).collect()
    assert {r.rate for r in zero} == {1.0}
    nulls = frame.withColumn("p0", F.lit(0.0))
    assert mixing.fit_rates(nulls, [0.5, 0.3, 0.2]).count() == 5


def test_mix_learns_domains_and_copies_rows(spark):
    rng = np.random.default_rng(5)
    words = {"news": ["vote", "law", "city"], "code": ["def", "return", "self"]}
    rows = []
    for i in range(300):
        d = "news" if i % 4 else "code"
        rows.append((i, " ".join(rng.choice(words[d] + ["the", "a"], 30)), d if i % 3 else None))
    rows += [(None, None, None), (900, "", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, domain string, _u int")
    mixed = mixing.mix(docs, docs, {"news": 0.5, "code": 0.5})
    got = mixed.toPandas()
    truth = [d for _, _, d in rows]
    own = got[(got.p_code - got.p_news).abs() > 0.8]
    assert len(own) >= 295
    share = (got.rate * got.n_tokens * got.p_code).sum() / (got.rate * got.n_tokens).sum()
    assert abs(share - 0.5) < 0.02 and truth.count("code") < 100
    out = mixing.apply_copies(docs, mixed)
    assert out.columns == docs.columns
    decided = {(None if r.doc_id != r.doc_id else r.doc_id, r.n_tokens): r.copies for r in got.itertuples()}
    counts = Counter(r.doc_id for r in out.collect())
    for i, t, _ in rows[:300]:
        if i != 5:
            assert counts[i] == decided[i, 30]
    assert counts[5] == 2 * decided[5, 30]
    assert mixing.mix(docs, docs.limit(0), {"news": 0.5, "code": 0.5}).select("p_code").distinct().collect()[0][0] == 0.5
    assert mixing.mix(docs.limit(0), docs, {"news": 0.5, "code": 0.5}).count() == 0


# ---- context tree ----

def normal(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return (" ".join(re.findall("[^\x20\x09-\x0D]+", low)) + "\n").encode()


def brute_tree(train, depth):
    """Counts and log Pw of every node (context, decided bits), by recursion."""
    counts = Counter()
    for text in train:
        data = b"\n" * depth + normal(text)
        for i in range(depth, len(data)):
            bits = f"{data[i]:08b}"
            for d in range(depth + 1):
                for j in range(8):
                    counts[data[i - d:i], bits[:j], bits[j]] += 1
    nodes = {(c, b) for c, b, _ in counts}
    kids = {}
    for c, b in nodes:
        if c:
            kids.setdefault((c[1:], b), []).append((c, b))
    pw = {}

    def kt(node):
        n0, n1 = counts[(*node, "0")], counts[(*node, "1")]
        return math.lgamma(n0 + .5) + math.lgamma(n1 + .5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1), n0, n1

    def weigh(node):
        own = kt(node)[0]
        if len(node[0]) == depth:
            pw[node] = own
        else:
            below = sum(weigh(k) for k in kids.get(node, []))
            pw[node] = np.logaddexp(own, below) - math.log(2)
        return pw[node]

    for j in {b for c, b in nodes if not c}:
        weigh((b"", j))

    def probability(context, bits, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            node = (context[len(context) - d:], bits)
            if node not in pw:
                p = 0.5
                continue
            own, n0, n1 = kt(node)
            one = (n1 + .5) / (n0 + n1 + 1)
            one = one if bit == "1" else 1 - one
            stop = 1.0 if d == depth else math.exp(own - math.log(2) - pw[node])
            p = stop * one + (1 - stop) * p
        return p

    return probability


TEXTS = ["The cat sat on the mat", "the cat  ate", "A dog sat\non the mat", None, "", "ünïcode the été", "the cat sat on the mat",
         "zebra xylophone"]


def test_context_tree_brute_force(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "the dog", None)]
    docs = documents(spark, rows).repartition(3)
    is_train = lambda i: i is not None and i % 3 != 1
    train = [t for i, t, _ in rows if is_train(i)]
    p = brute_tree(train, 3)
    got = context_tree.context_tree_scores(docs, F.col("doc_id") % 3 != 1, depth=3).collect()
    words = Counter(w for t in train for w in [*re.findall(b"[^ \n]+", normal(t)), None])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        data, r = b"\n\n\n" + normal(t), by[i]
        want = 0.0
        for k in range(3, len(data)):
            bits = f"{data[k]:08b}"
            want += sum(math.log10(p(data[k - 3:k], bits[:j], bits[j])) for j in range(8))
        assert r.score == pytest.approx(want, rel=1e-5)
        tokens = [*re.findall(b"[^ \n]+", normal(t)), None]
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (
            len(tokens), sum(words[w] > 0 for w in tokens), n, is_train(i))


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(20)) for _ in range(10)]
    keys = context_tree.Slice(pa.array(texts), 3).key
    own, counts = np.unique(keys, return_counts=True)
    tree = context_tree.Subtrees(own, counts, 3)
    node, n0, n1 = tree.top
    top = context_tree.Top([{"context": int(k) >> 8, "node": int(k) & 255, "n0": a, "n1": b, "lw": w}
                            for k, a, b, w in zip(node, n0, n1, tree.top_children)])
    for context in (own[0] >> np.uint64(8), own[len(own) // 2] >> np.uint64(8), np.uint64(0x7A7A7A), np.uint64(0x610000)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.log10(every, top)).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.concatenate([np.arange(1, 200) / 2, [1e4, 1e7, 1e12]])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_context_tree_edges(spark):
    docs = documents(spark, [(1, "abc", None), (2, None, None)])
    none = {r.doc_id: r for r in context_tree.context_tree_scores(docs, F.lit(False)).collect()}
    assert none[1].score == pytest.approx(4 * 8 * math.log10(0.5), rel=1e-6)
    assert (none[2].n_tokens, none[2].n_known, none[2].train_tokens, none[2].base_score) == (1, 0, 0, 0.0)
    assert context_tree.context_tree_scores(docs.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        context_tree.context_tree_scores(docs, F.lit(True), depth=1)


def test_held_out_texts_cost_less_than_random_ones(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    got = context_tree.context_tree_scores(docs, crc_mod("doc_id", 7) != 2).where("not train").agg(
        F.sum("score"), F.sum("n_bytes")).first()
    assert -got[0] / math.log10(2) / got[1] < 2.5
