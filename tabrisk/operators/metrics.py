"""Folds, thresholded decisions and exact binary metrics.

All metrics are one grouped aggregation over the scored rows (``by`` holds
e.g. the fold).  ROC-AUC is exact with ties counted half:
``sum over scores of pos * (negatives below + negatives tied / 2) / (P * N)``,
from a ``(group, score)`` count table; the running count of negatives below a
score is a two-level scan (``ranking.prefix_sums``), so no single task orders a
whole fold, however large.  Groups may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.operators.ranking import ROWS_PER_BUCKET, _cols, hash_rank, join_groups, key_rank, prefix_sums

METRIC_NAMES = ["Accuracy", "Precision", "Recall", "F1", "ROC-AUC"]


def with_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
               name: str = "fold", shuffle: bool = True) -> DataFrame:
    """Stratified folds: rank within class, modulo ``k``; in seeded random order
    or, unshuffled, in the order of the key.

    Per class the fold sizes differ by at most one.
    """
    if shuffle:
        ranked = hash_rank(df, label, key, seed, "fold", "_fold_rank")
    else:
        ranked = key_rank(df, label, key, "_fold_rank")
    return ranked.withColumn(name, (F.col("_fold_rank") % k).cast("int")).drop("_fold_rank")


def decide(df: DataFrame, prob: str, threshold: float = 0.1, name: str = "decision",
           labels: tuple[str, str] = ("No Risk", "Risk")) -> DataFrame:
    """``prob >= threshold`` as 0/1 and as a text label."""
    d = (F.col(prob) >= F.lit(threshold)).cast("int")
    return df.withColumn(name, d).withColumn(
        f"{name}_label", F.when(d == 1, F.lit(labels[1])).otherwise(F.lit(labels[0])))


def auc_exact(df: DataFrame, label: str, score: str, by=None, name: str = "ROC-AUC",
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact ROC-AUC per group with tied scores counted half; NULL without both classes."""
    g = _cols(by)
    y = F.col(label).cast("int")
    ungrouped = not g
    if ungrouped:
        df, g = df.withColumn("_one", F.lit(1)), ["_one"]
    counts = df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    # negatives with a smaller score in the same group; a row is one score of one group
    c = prefix_sums(counts, g, ["_s"], {"_nb": F.col("_neg")}, rows_per_bucket)
    agg = c.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") / 2.0)).alias("_num"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    den = F.col("_P").cast("double") * F.col("_N")
    out = agg.select(*g, F.when(den > 0, F.col("_num") / den).alias(name))
    return out.drop("_one") if ungrouped else out


def binary_metrics(df: DataFrame, label: str, pred: str, score: str | None = None,
                   by=None) -> DataFrame:
    """Accuracy, Precision, Recall, F1 (class 1; zero denominators give 0) and ROC-AUC."""
    g = _cols(by)
    ungrouped = not g
    if ungrouped:  # a constant group keeps the AUC join an equi-join
        df, g = df.withColumn("_g", F.lit(0)), ["_g"]
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    counts = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    out = counts.select(
        *g, "n", "tp", "fp", "fn", "tn",
        ratio(tp + tn, F.col("n").cast("double")).alias("Accuracy"),
        ratio(tp, tp + fp).alias("Precision"),
        ratio(tp, tp + fn).alias("Recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("F1"))
    if score is not None:
        out = join_groups(out, auc_exact(df, label, score, g), g)
    return out.drop("_g") if ungrouped else out


def cv_summary(metrics: DataFrame, names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """One row: ``<metric>_mean`` and population ``<metric>_std`` over the folds."""
    aggs = []
    for m in names:
        aggs += [F.avg(F.col(f"`{m}`")).alias(f"{m}_mean"), F.stddev_pop(F.col(f"`{m}`")).alias(f"{m}_std")]
    return metrics.agg(*aggs)
