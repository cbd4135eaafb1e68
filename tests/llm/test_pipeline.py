"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tabrisk.llm.tokens import encoder, vocabulary
from test_copies import brute_components, shingle_sets


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    frames = list(steps.values())
    for df in frames[1:-1]:
        assert df.columns == frames[0].columns


def test_language_keeps_documents_with_words(steps):
    kept = {i for i, _ in rows(steps["language_id"])}
    for i, t in rows(steps["documents"]):
        assert (i in kept) >= (len(re.findall("[a-zA-Z]{2,}", t or "")) >= 20)


def test_exact_copies(steps):
    least = {}
    for i, t in sorted(rows(steps["language_id"])):
        least.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t or ""), i)
    assert sorted(i for i, _ in rows(steps["exact_dedup"])) == sorted(least.values())


def test_one_of_each_near_group(steps):
    own = rows(steps["exact_dedup"])
    want = {c if n else i for i, n, c in brute_components(own)}
    assert {i for i, _ in rows(steps["ngram_dedup"])} == want


def test_mixture_repeats_or_drops_whole_rows(steps):
    before, after = Counter(rows(steps["ngram_dedup"])), Counter(rows(steps["source_mixing"]))
    assert set(after) <= set(before)
    tokens = lambda c: sum(n * len((t or "").split()) for (_, t), n in c.items())
    assert abs(tokens(after) / tokens(before) - 1) < 0.15


def test_packed_sequences(steps):
    enc = encoder(vocabulary())
    want = Counter()
    for (i, t), n in Counter(rows(steps["source_mixing"])).items():
        want[i] += n * (len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    got = steps["best_fit_packing"].toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == dict(want)
    total = 0
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 4096
        total += 1
    assert total <= -(-sum(want.values()) // 4096) * 1.05 + 1


def test_edges(spark, tmp_path):
    """An empty table, and rows with NULLs, repetitions and odd texts, pass every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int"
    long = "hello there friend " * 20000
    data = [(1, None, None, None, None, 1), (None, "hello there my friend", "en", "a", 1, 1), (2, "", "en", None, 0, 1),
            (3, "hello there my friend", "en", "a", 1, 1), (3, "hello there my friend", "en", "a", 1, 1),
            (4, "bonjour mon ami comment ca va", "fr", "b", 1, 1), (5, long, "en", "b", 1, 1)]
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for number, own in enumerate((data, [])):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            result.write.parquet(f"{tmp_path}/{number}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{number}-{name}")
        assert (docs.count() > 0) == (number == 0)


def test_import_guard_lets_the_rest_work(tmp_path):
    """Without the subpackage and the pipeline, the entry module still has the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
