"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabrisk.llm.context_tree import context_tree_scores
from tabrisk.llm.conversations import damage, repair_digest
from tabrisk.llm.embeddings import near_duplicates
from tabrisk.llm.exact_dedup import exact_dedup
from tabrisk.llm.language import fit_language, predict_language
from tabrisk.llm.mixing import mix, quality_domains
from tabrisk.llm.ngram_join import ngram_components
from tabrisk.llm.packing import pack_documents
from tabrisk.llm.quality import fit_quality, score_quality
from tabrisk.llm.shared import crc_mod, table
from tabrisk.llm.suffix_index import remove_repeats
from tabrisk.llm.token_counts import token_counts
from tabrisk.llm.token_files import token_file_digest
from tabrisk.llm.tokens import vocabulary
from tabrisk.llm.whitening import whiten

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, crc_mod("doc_id", 5) != 0)
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op2_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op3_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) AS component_id,
       (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) = e.vec_id AS kept
FROM embeddings e""")
def op3_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_quality(docs, labels.where(crc_mod("doc_id", 3) != 1))
    out = score_quality(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Shares of the training mixture's tokens.
MIXTURE = {"clean": 0.90, "low": 0.07, "toxic": 0.03}


def labelled_domains(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", quality_domains(labels).alias("domain"))


@query("op6_source_mixing")
def op6_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, labelled_domains(spark, sf_dir), MIXTURE).drop("_u")


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    return token_file_digest(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@query("op9_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
first AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, first.component_id
FROM documents d JOIN first USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id""")
def op9_ngram_jaccard(spark, sf_dir):
    out = ngram_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query("op10_lm_scores")
def op10_lm_scores(spark, sf_dir):
    out = context_tree_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score", "n_bytes")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_suffix_array_dedup")
def op12_suffix_array_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations")
    return repair_digest(damage(convs), convs)
