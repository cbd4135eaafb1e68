"""Correlation-driven feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabrisk.operators.profile import corr_with


def select_by_corr(df: DataFrame, target: str, candidates: Sequence[str],
                   threshold: float = 0.2, exclude: Sequence[str] = ()) -> tuple[list[str], DataFrame]:
    """Columns with ``|corr(c, target)| > threshold`` in candidate order; target always kept.

    Returns the selected names (a fitted parameter, collected) and the
    correlation table.  A constant column has NULL correlation and is not
    selected.
    """
    selected, table, _ = select_by_corr_with_means(df, target, candidates, threshold, exclude, False)
    return selected, table


def select_by_corr_with_means(df: DataFrame, target: str, candidates: Sequence[str],
                              threshold: float = 0.2, exclude: Sequence[str] = (),
                              with_mean: bool = True) -> tuple[list[str], DataFrame, dict]:
    """:func:`select_by_corr` plus the mean of every candidate, from the same
    pass over the data (one row per candidate is collected)."""
    cands = [c for c in candidates if c not in set(exclude)]
    table = corr_with(df, target, cands, with_mean=with_mean)
    rows = table.collect()  # one row per candidate column
    passed = {r["feature"] for r in rows if r["abs_corr"] is not None and r["abs_corr"] > threshold}
    means = {r["feature"]: r["mean"] for r in rows} if with_mean else {}
    selected = [c for c in cands if c in passed]
    if target not in selected:
        selected.append(target)
    return selected, table, means
