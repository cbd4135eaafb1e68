"""Exact deduplication by a tree merge of sorted digest runs (DataFrame only).

Every row is reduced to the SHA-256 of its normalised text (white-space runs
become one space, NULL counts as empty) plus two witnesses, its byte length
and an independent 64-bit hash.  Two entries are merged only if digest *and*
witnesses agree, at every level, so the smallest identifier that survives is
verified against three independent values.

Rows are dealt to ``P = radix ** rounds`` runs by a hash of the identifier and
each run is reduced to one entry per digest (smallest identifier, number of
rows).  The runs then meet in binomial rounds: in round ``r`` the ``radix``
runs that differ only in digit ``r`` of their number exchange entries, an
entry going to the run whose digit ``r`` is the digest's; what a run receives
is merged in digest order.  After the last round run ``i`` holds exactly the
digests with prefix ``i``, fully merged, and no run ever holds more than its
share: a digest carried by a third of all rows is one entry per run from the
first level on.  Decisions travel back down by (first run, digest), so the
copies of one text are never gathered in one task either.

Defined results: NULL text equals empty text; a NULL identifier stays only if
all identifiers of its text are NULL; repeated rows (same identifier and
text) count each in ``group_size`` and one of them stays (``kept`` of the
decisions is true for each of them, :func:`drop_copies` returns one); an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.shared import SPACES, cut

RADIX_BITS = 3            # eight runs meet in each round
ROWS_PER_RUN = 1_000_000  # entries of a run aimed at
KEY = ["_digest", "_bytes", "_witness"]


def _digests(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return (docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), *keep)
            .withColumn("_hex", F.sha2(F.col("_norm"), 256))
            .select("_id", F.unhex("_hex").alias("_digest"), F.octet_length("_norm").alias("_bytes"),
                    F.xxhash64("_norm").alias("_witness"), *keep))


def _run(rounds: int):
    """First run of a row, from its identifier."""
    return F.pmod(F.xxhash64(F.lit("run"), "_id"), F.lit(1 << (RADIX_BITS * rounds)))


def _prefix():
    return F.conv(F.hex(F.substring("_digest", 1, 7)), 16, 10).cast("bigint")


def _smallest(col: str):
    # NULL identifiers last: max/min skip NULL anyway, so a plain min does it
    return F.min(col)


def _merge_tree(level0: DataFrame, rounds: int) -> DataFrame:
    """One row per text: ``KEY, keep_id, group_size``."""
    runs = level0
    for r in range(rounds):
        shift = RADIX_BITS * r
        mask = (1 << RADIX_BITS) - 1
        digit = F.shiftright(_prefix(), shift).bitwiseAND(F.lit(mask))
        dest = F.col("_run").bitwiseAND(F.lit(~(mask << shift))).bitwiseOR(F.shiftleft(digit, shift))
        runs = (runs.withColumn("_run", dest)
                .repartition("_run").sortWithinPartitions("_run", *KEY)
                .groupBy("_run", *KEY)
                .agg(_smallest("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return runs.drop("_run")


def _tree(digests: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(entries of the first runs, merged entries, rounds) of a digest table."""
    rows = digests.count()
    rounds = 1
    while (1 << (RADIX_BITS * rounds)) * ROWS_PER_RUN < rows:
        rounds += 1
    rounds = max(rounds, 2)  # at least 64 runs, so that small tables merge in rounds too
    level0 = (digests.withColumn("_run", _run(rounds)).groupBy("_run", *KEY)
              .agg(_smallest("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return level0, _merge_tree(level0, rounds), rounds


def _way_back(level0: DataFrame, merged: DataFrame) -> DataFrame:
    """Decisions of texts with copies, one row per first run that saw the text."""
    several = merged.where(F.col("group_size") > 1)
    return level0.select("_run", *KEY).join(several, KEY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256``."""
    digests = cut(_digests(docs, id_col, text_col))
    level0, merged, rounds = _tree(digests)
    back = _way_back(level0, merged)
    rows = digests.withColumn("_run", _run(rounds)).join(back, ["_run", *KEY], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    digests = cut(_digests(docs, id_col, text_col))
    level0, merged, rounds = _tree(digests)
    back = _way_back(level0, merged).select("_run", *KEY, F.col("keep_id").alias("_keep"), F.lit(True).alias("_several"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    rows = _digests(whole, "_i", "_t", "_row").withColumn("_run", _run(rounds))
    stay = rows.join(back, ["_run", *KEY], "left").where(
        F.col("_several").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    # rows that repeat the identifier that stays are one; grouped as the join left them
    return stay.dropDuplicates(["_run", *KEY]).select("_row.*")
