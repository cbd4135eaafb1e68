"""Every registered query of the subpackage runs, with its columns, and matches its SQL."""

import zlib

import pytest

import corpus_pipeline
from compare import same_rows
from tabrisk.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_embedding_near_dedup": "vec_id n_links component_id kept",
    "op4_token_counts": "doc_id section start end n_tokens n_crossing",
    "op5_quality_classifier": "doc_id held_out score predicted",
    "op6_source_mixing": "doc_id n_tokens rate copies residual",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_ngram_jaccard": "doc_id n_shingles component_id",
    "op10_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}
HELD_OUT = {"op1_language_id": (5, 0), "op5_quality_classifier": (3, 1), "op10_lm_scores": (7, 2)}


def test_all_are_listed():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name in ORACLES:
        ok, why = same_rows(got, duck.execute(ORACLES[name]).df())
        assert ok, why
    elif "doc_id" in got.columns:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").toPandas()
        assert set(got.doc_id) == set(docs.doc_id)
    if name in HELD_OUT:
        mod, rest = HELD_OUT[name]
        assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    if name in ("op1_language_id", "op5_quality_classifier"):
        assert got.score.between(0, 1).all() and len(got) == got.doc_id.nunique()
