"""Profiling: counts, distinct values, value counts, missing counts, numeric
summary and correlation with a target.

Every profile is one aggregation pass (several columns are unpivoted into
``(feature, value)`` and counted together) instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.operators.quantiles import exact_quantiles
from tabrisk.session import cut_lineage


def row_count(df: DataFrame, conditions: dict | None = None) -> DataFrame:
    """``n_rows``, ``n_columns`` and optional named conditional counts, one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, cond in (conditions or {}).items():
        aggs.append(F.count_if(cond).alias(name))
    return df.agg(*aggs).withColumn("n_columns", F.lit(len(df.columns)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col``, missing included."""
    return df.select(F.col(col).alias("value")).distinct()


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """``value, count`` (and ``proportion``) descending, missing excluded."""
    vc = (df.where(F.col(col).isNotNull())
          .groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count")))
    if normalize:
        # the total is the sum of the counts (a one-row aggregate): one scan of the table
        vc = cut_lineage(vc)
        total = vc.agg(F.sum("count").alias("_total")).withColumn("_one", F.lit(1))
        vc = (vc.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
              .withColumn("proportion", F.col("count") / F.col("_total")).drop("_one", "_total"))
    return vc.orderBy(F.desc("count"), F.asc("value"))


def _long_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")


def profile_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one aggregation: ``feature, value, count``."""
    return (_long_strings(df, cols).where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("feature", F.desc("count"), "value"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, n_missing`` for every column, one aggregation."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_missing")


def column_types(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Schema as a small table ``pos, column, type``."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "pos int, column string, type string")


DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 %, max per numeric column.

    Moments come from one wide aggregation; quantiles from
    :func:`exact_quantiles` over the unpivoted columns (same numbers as pandas
    ``describe`` and DuckDB ``quantile_cont``).
    """
    cols = list(cols)
    dbl = df.select([F.col(c).cast("double").alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
                 F.max(c).alias(f"{c}__max")]
    wide = dbl.agg(*aggs)
    stack = ", ".join(
        f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in cols)
    moments = wide.selectExpr(
        f"stack({len(cols)}, {stack}) as (feature, count, mean, std, min, max)")
    longv = dbl.unpivot([], cols, "feature", "value")
    q = exact_quantiles(longv, "value", DESCRIBE_PROBS, ["feature"])
    qw = q.groupBy("feature").agg(*[
        F.max(F.when(F.col("q_index") == i, F.col("quantile"))).alias(name)
        for i, name in enumerate(["p25", "p50", "p75"])])
    return moments.join(qw, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def corr_with(df: DataFrame, target: str, cols: Sequence[str], with_mean: bool = False) -> DataFrame:
    """Pearson correlation of each column with ``target`` (pairwise complete).

    ``covar_pop / (stddev_pop * stddev_pop)`` over the rows where both sides
    are present; a constant column gives NULL instead of the division error
    that ``corr`` raises under ANSI mode.  One aggregation for all columns;
    ``with_mean`` adds each column's mean over its present values to the
    same pass.
    """
    t = F.col(target).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        both = x.isNotNull() & t.isNotNull()
        xm, tm = F.when(both, x), F.when(both, t)
        aggs += [F.covar_pop(xm, tm).alias(f"{c}__cov"),
                 F.stddev_pop(xm).alias(f"{c}__sx"), F.stddev_pop(tm).alias(f"{c}__st"),
                 (F.avg(x) if with_mean else F.lit(None).cast("double")).alias(f"{c}__mean")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__cov`, `{c}__sx`, `{c}__st`, `{c}__mean`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, cov, sx, st, mean)")
    denom = F.col("sx") * F.col("st")
    corr = F.when(denom > 0, F.col("cov") / denom)
    out = long.select(
        F.col("feature"), corr.alias("corr"), F.abs(corr).alias("abs_corr"),
        F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).cast("int").alias("pos"),
        "mean")
    return out if with_mean else out.drop("mean")


__all__ = ["row_count", "distinct_values", "value_counts", "profile_categorical",
           "missing_counts", "column_types", "describe", "corr_with"]
