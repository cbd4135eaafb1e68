"""Row validity filters and key-based row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.functions.text import strip_ws


def filter_valid_category(df: DataFrame, col: str, reject: str = "other",
                          strip_before_reject: bool = False) -> DataFrame:
    """Keep rows whose ``col`` is present, not blank and not ``reject``.

    The reject test is case-insensitive and, by default, on the *unstripped*
    value (so ``' Other '`` survives), as in the original cleaning step;
    ``strip_before_reject=True`` strips first.
    """
    c = F.col(col)
    tested = strip_ws(c) if strip_before_reject else c
    return df.where(c.isNotNull() & (strip_ws(c) != "") & (F.lower(tested) != reject.lower()))


def take_keys(df: DataFrame, keys: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Rows of ``df`` whose key is listed in ``keys(key, pos)``, in ``pos`` order.

    An equi-join on the key: the key list is broadcast by AQE when its
    measured size allows, otherwise both sides are shuffled on the key.
    """
    return df.join(keys.select(key, pos), key).orderBy(pos)


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is *not* listed in ``keys`` (anti-join)."""
    return df.join(keys.select(key), key, "left_anti")


def lookup_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(found rows, requested keys without a row)`` — the bounds check of a point lookup."""
    found = df.join(keys.select(key), key, "left_semi")
    missing = keys.select(key).join(df.select(key), key, "left_anti")
    return found, missing


def align(scaled: DataFrame, display: DataFrame, key: str, suffix: str = "_original") -> DataFrame:
    """Twin tables joined on the key; display columns get ``suffix``."""
    disp = display.select(key, *[F.col(c).alias(c + suffix) for c in display.columns if c != key])
    return scaled.join(disp, key)
