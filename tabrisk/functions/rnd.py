"""Partition-independent randomness.

Spark's ``rand(seed)`` depends on the partition a row lands in, so a retried
task or a repartitioned input draws different numbers.  Every random choice in
this package is instead a function of ``(seed, tag, key)`` through md5: the
first 13 hex digits (52 bits, all that a double holds exactly) divided by 2**52 give a uniform number in [0, 1) that is
bit-identical in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(seed: int | str, tag: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string"))


def uniform(seed: int | str, tag: str, key: Column | str) -> Column:
    """Uniform double in [0, 1) drawn from md5(seed:tag:key)."""
    hexed = F.substring(F.md5(hash_text(seed, tag, key)), 1, 13)
    return F.conv(hexed, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def sql_uniform(seed: int | str, tag: str, key_sql: str) -> str:
    """DuckDB form of :func:`uniform` (used by oracle SQL)."""
    text = f"'{seed}:{tag}:' || CAST({key_sql} AS VARCHAR)"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
