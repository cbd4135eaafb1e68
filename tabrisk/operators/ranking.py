"""Dense ranks without a single-task window.

``row_number() over (order by x)`` with no partition runs in one task.  Here a
dense rank is computed in three distributed steps:

1. every row gets a *bucket* that is monotone in the ordering
   (a hash prefix for random orders, a range bucket for key orders);
2. rows per ``(group, bucket)`` are counted and turned into offsets with a
   window over that small count table;
3. the rank is ``offset + row_number()`` inside ``(group, bucket)``.

Buckets are balanced by construction (a uniform hash, or quantile boundaries
of a unique key), so no task holds more than about ``n / buckets`` rows even
when one group holds a third of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.functions.rnd import uniform
from tabrisk.session import cut_lineage

HASH_BITS = 16  # 65,536 hash buckets per group


def _cols(cols: Sequence[str] | str | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def join_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which NULL equals NULL."""
    renamed = right.withColumnsRenamed({c: f"_j_{c}" for c in cols})
    on = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in cols]
    return left.join(renamed, on, how).drop(*[f"_j_{c}" for c in cols])


def rank_in_buckets(df: DataFrame, group_cols, bucket: Column, order: Sequence[Column],
                    name: str = "rank") -> DataFrame:
    """0-based dense rank within ``group_cols`` by (bucket, *order).

    ``bucket`` must be non-decreasing in ``order`` for the rank to follow
    ``order``; ties in ``order`` must be broken by the caller (a unique key).
    """
    g = _cols(group_cols)
    b = "_rk_bucket"
    with_b = df.withColumn(b, bucket)
    counts = with_b.groupBy(*g, b).agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    # groups x buckets rows: small; AQE broadcasts it when its measured size allows
    offsets = counts.select(*g, b, F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"))
    inner = Window.partitionBy(*g, b).orderBy(*order)
    return (join_groups(with_b, offsets, [*g, b])
            .withColumn(name, (F.col("_rk_off") + F.row_number().over(inner) - 1).cast("bigint"))
            .drop(b, "_rk_off"))


def hash_rank(df: DataFrame, group_cols, key: str, seed: int, tag: str,
              name: str = "rank", u_name: str | None = None) -> DataFrame:
    """Dense rank within groups in the random order md5(seed:tag:key), ties by key.

    The exact set-based replacement of "shuffle the group, then take rows by
    position": partition-independent, so a retried task draws the same rows.
    """
    u = uniform(seed, tag, F.col(key))
    u_col = u_name or "_u"
    out = df.withColumn(u_col, u)
    bucket = F.floor(F.col(u_col) * (1 << HASH_BITS))
    out = rank_in_buckets(out, group_cols, bucket, [F.col(u_col), F.col(key)], name)
    return out if u_name else out.drop(u_col)


#: Rows of a range bucket aimed at; the number of buckets follows the table.
ROWS_PER_BUCKET = 1_000_000


def prefix_sums(df: DataFrame, group_cols, order: Sequence[str], sums: Mapping[str, Column],
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add, for each of ``sums``, its total over the rows of the group that come
    before in ``order`` (columns that tell the rows of a group apart).

    A scan in two levels: rows are dealt to range buckets by group and order
    (Spark samples the bounds), so many that a bucket holds about
    ``rows_per_bucket`` rows, a group of any size spread over many and many small
    groups in one; buckets are totalled and the totals summed, a row per bucket
    and group; each bucket then adds up its own rows.  NULL groups are groups.
    """
    g = _cols(group_cols)
    own = df.withColumns({f"_ps_{n}": c for n, c in sums.items()})
    buckets = max(1, -(-df.count() // rows_per_bucket))
    dealt = cut_lineage(own.repartitionByRange(buckets, *g, *order).withColumn("_ps_b", F.spark_partition_id()))
    totals = dealt.groupBy(*g, "_ps_b").agg(*[F.sum(f"_ps_{n}").alias(f"_ps_t_{n}") for n in sums])
    before = Window.partitionBy(*g).orderBy("_ps_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_ps_b", *[F.coalesce(F.sum(f"_ps_t_{n}").over(before), F.lit(0)).alias(f"_ps_o_{n}") for n in sums])
    inner = Window.partitionBy(*g, "_ps_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_groups(dealt, offsets, [*g, "_ps_b"])
    out = out.withColumns({n: F.col(f"_ps_o_{n}") + F.coalesce(F.sum(f"_ps_{n}").over(inner), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def key_rank(df: DataFrame, group_cols, key: str, name: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Dense 0-based rank within groups in ascending order of the unique ``key`` (any orderable type)."""
    return prefix_sums(df, group_cols, [key], {name: F.lit(1).cast("bigint")}, rows_per_bucket)


def with_row_index(df: DataFrame, key: str, name: str = "row_index", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Dense 0..n-1 index in ascending order of the unique ``key`` (any orderable type)."""
    return key_rank(df, None, key, name, rows_per_bucket)


def bottom_k(df: DataFrame, order: Sequence[Column], k: int, group_cols=None, name: str | None = None) -> DataFrame:
    """The ``k`` first rows of each group in ``order`` (of the table without groups),
    with their 1-based rank as ``name``.

    Mergeable: every task keeps its own ``k`` first rows of a group (a group limit,
    or without groups a top-k), and only those are shuffled.
    """
    g = _cols(group_cols)
    rank = name or "_bk_rank"
    if g:
        out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*g).orderBy(*order))).where(F.col(rank) <= k)
    else:
        out = df.orderBy(*order).limit(k)
        if name:
            out = out.withColumn(rank, F.row_number().over(Window.orderBy(*order)))  # k rows
    return out if name else out.drop(rank)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key`` (a preview, P9)."""
    return bottom_k(df, [F.col(key).asc_nulls_last()], n)


def first_n(df: DataFrame, key: str, n: int, group_cols=None) -> DataFrame:
    """The first ``n`` rows of each group by ``key`` (T4)."""
    return bottom_k(df, [F.col(key).asc_nulls_last()], n, group_cols)


def last_row(df: DataFrame, key: str, group_cols=None) -> DataFrame:
    """The last row of each group by ``key`` (T4)."""
    return bottom_k(df, [F.col(key).desc_nulls_last()], 1, group_cols)
