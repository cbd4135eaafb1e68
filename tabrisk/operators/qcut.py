"""Quantile binning with collapsed duplicate edges (``qcut``, codes only)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.operators.quantiles import quantile_array
from tabrisk.operators.ranking import _cols, join_groups


def qcut_probs(q: int) -> list[float]:
    # the same probability values as an evenly spaced grid from 0 to 1
    return [float(p) for p in np.linspace(0.0, 1.0, q + 1)]


def bin_code(x: Column, edges: Column) -> Column:
    """Right-closed bins, lowest edge included: number of edges below x, minus 1."""
    return F.when(x.isNotNull(), F.greatest(
        F.lit(0), F.size(F.filter(edges, lambda e: e < x)) - 1)).cast("int")


def qcut_edges(df: DataFrame, col: str, q: int, group_cols=None, name: str = "edges") -> DataFrame:
    """Exact quantile edges per group, duplicates dropped (sorted)."""
    g = _cols(group_cols)
    qa = quantile_array(df, col, qcut_probs(q), g, name="_q")
    return qa.select(*g, F.array_sort(F.array_distinct("_q")).alias(name))


def qcut_many(df: DataFrame, spec: list[tuple[str, int]], group_cols=None,
              suffix: str = "_bin") -> DataFrame:
    """Bin several columns in one quantile pass: ``spec = [(col, q), ...]``.

    The columns are unpivoted into ``(feature, value)`` so that all edges come
    from a single exact-quantile computation grouped by (feature, groups).
    """
    g = _cols(group_cols)
    cols = [c for c, _ in spec]
    probs = sorted({p for _, q in spec for p in qcut_probs(q)})
    long = df.select(*g, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        g or [], cols, "_feature", "_value") if g else df.select(
        *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "_feature", "_value")
    qa = quantile_array(long, "_value", probs, ["_feature", *g], name="_q")
    # pick, per feature, the probabilities of its own q
    wanted = F.create_map(*[x for c, q in spec for x in (
        F.lit(c), F.array(*[F.lit(probs.index(p)) for p in qcut_probs(q)]))])
    edges = qa.select("_feature", *g, F.array_sort(F.array_distinct(F.transform(
        F.element_at(wanted, F.col("_feature")), lambda i: F.element_at("_q", i + 1)))).alias("_e"))
    wide = edges.groupBy(*g).agg(*[
        F.max(F.when(F.col("_feature") == c, F.col("_e"))).alias(f"_e_{c}") for c in cols])
    if g:
        out = join_groups(df, wide, g, "left")  # one row per group: AQE broadcasts it by size
    else:
        out = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(wide.withColumn("_one", F.lit(1))), "_one").drop("_one")
    for c in cols:
        out = out.withColumn(c + suffix, bin_code(F.col(c).cast("double"), F.col(f"_e_{c}")))
    return out.drop(*[f"_e_{c}" for c in cols])


def qcut(df: DataFrame, col: str, q: int, group_cols=None, name: str | None = None) -> DataFrame:
    """Add ``name`` (default ``<col>_bin``): the quantile bin code within each group."""
    g = _cols(group_cols)
    name = name or f"{col}_bin"
    edges = qcut_edges(df, col, q, g, "_edges")
    if g:
        # one row per group: small, AQE broadcasts it by measured size
        out = join_groups(df, edges, g, "left")
    else:
        out = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return out.withColumn(name, bin_code(F.col(col).cast("double"), F.col("_edges"))).drop("_edges")
