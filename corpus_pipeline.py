"""A corpus pipeline over ``documents``: language, exact copies, near copies,
mixture, packing.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  All but the last return the columns they got.  ``run``
writes every stage's result as Parquet in the shared folder and reads it again
as the next stage's input, so a stage starts from a table, not from a plan.

* ``language_id`` keeps the documents whose language is recognised.
* ``exact_dedup`` keeps, of texts equal up to white space, the smallest doc_id.
* ``ngram_dedup`` keeps one document of each group linked by 5-word shingles
  at a Jaccard similarity of 0.8 or more.
* ``source_mixing`` repeats or leaves out documents so that the expected tokens
  of the domains have the target shares; a document may occur several times.
* ``best_fit_packing`` returns the pieces with their sequences.
"""

from __future__ import annotations

import uuid

from tabrisk.llm.exact_dedup import drop_copies
from tabrisk.llm.language import keep_identified
from tabrisk.llm.mixing import apply_copies, mix
from tabrisk.llm.ngram_join import drop_near_copies
from tabrisk.llm.packing import pack_documents
from tabrisk.llm.queries import MIXTURE, labelled_domains
from tabrisk.llm.shared import crc_mod
from tabrisk.llm.tokens import vocabulary
from tabrisk.session import checkpoint_dir


def language_id(spark, docs, sf_dir):
    return keep_identified(docs, crc_mod("doc_id", 5) != 0)


def exact_dedup(spark, docs, sf_dir):
    return drop_copies(docs)


def ngram_dedup(spark, docs, sf_dir):
    return drop_near_copies(docs)


def source_mixing(spark, docs, sf_dir):
    return apply_copies(docs, mix(docs, labelled_domains(spark, sf_dir), MIXTURE))


def best_fit_packing(spark, docs, sf_dir):
    return pack_documents(docs, vocabulary(), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_dedup", ngram_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt models and sub-word ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
