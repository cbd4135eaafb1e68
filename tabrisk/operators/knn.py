"""Exact k-nearest-neighbour join without all pairs.

Distance is the NaN-aware Euclidean distance used by kNN imputation:
``sqrt(n / m * sum of squared differences over the m columns present in both
rows)`` with ``n`` the number of columns; undefined (NULL) when ``m = 0``.
Ties are broken by the donor key, so the result is deterministic.

Rows may lack any columns.  A query's and a donor's gap pattern (which columns are
present) meet on the columns they share; each (donor pattern, shared columns)
that occurs is a root of one cell tree, and all roots are searched together, so
the number of jobs does not depend on the patterns.

1. Donors with identical coordinates under a root are reduced to the ``k`` smallest keys
   (a top-k window, planned as a partial limit before the shuffle): only
   those can ever be chosen, so a value repeated by a third of the table
   costs ``k`` rows.  Queries with identical coordinates have identical
   neighbours, so the search runs once per distinct query vector.
2. The tree grows level by level.  A cell with more than ``cell_target`` donors
   is cut at up to 31 quantiles of one axis, the one with the most of them
   (weighted by the share of queries that have the column), and its parts are
   cells of the next level; heavy parts are cut again, so cells stay small
   whatever the distribution and the number of donors.  Every cell knows the box
   of its donors.  Cells are rows of tables, never collected.
3. Each query goes down to one cell per root; its ``k`` nearest there (or, in a
   cell with fewer, the far corner of the parent's box) bound the distance of
   the true neighbours.
4. It goes down again, into every cell whose box is within the smallest bound,
   and the donors met there are ranked by (distance, key).

Each level is a scratch table that the next one reads, so plans stay as small as
one level's, however deep the tree.  The result is checkpointed, and every frame
and table that was kept on the way is freed before it is returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.operators.ranking import join_groups
from tabrisk.session import Held, cut_lineage

FAN_OUT = 32
EPS_REL = 1e-9
_CUTS = [i / FAN_OUT for i in range(1, FAN_OUT)]


def nan_distance(q: Sequence[Column], d: Sequence[Column], n_cols: int) -> Column:
    """``sqrt(n/m * sum(diff^2))`` over the m columns present in both; NULL if m = 0."""
    present = [qc.isNotNull() & dc.isNotNull() for qc, dc in zip(q, d)]
    ssum = None
    m = None
    for p, qc, dc in zip(present, q, d):
        term = F.when(p, (qc - dc) * (qc - dc)).otherwise(F.lit(0.0))
        cnt = p.cast("int")
        ssum = term if ssum is None else ssum + term
        m = cnt if m is None else m + cnt
    return F.when(m > 0, F.sqrt(F.lit(float(n_cols)) / m * ssum))


# ---- the cell tree ---------------------------------------------------------------
#
# A cell is (_g, _node): the number of its root and its own, 1 for the root and
# FAN_OUT * number + part for the parts of a cell.

def _bin(x: Column, edges: Column) -> Column:
    """The part of a cell: number of edges below ``x``."""
    return F.size(F.filter(edges, lambda e: e < x))


def _above(node: str = "_node") -> Column:
    return F.expr(f"{node} div {FAN_OUT}")


def _on_axis(prefix: str, cols: Sequence[str], axis: str = "_axis") -> Column:
    return F.coalesce(*[F.when(F.col(axis) == i, F.col(f"{prefix}{c}")) for i, c in enumerate(cols)])


def _part(prefix: str, cols: Sequence[str]) -> Column:
    return F.col("_node") * FAN_OUT + _bin(_on_axis(prefix, cols), F.col("_edges"))


def _cells(d: DataFrame, cols: Sequence[str], target: int) -> DataFrame:
    """Size, box and, if it is to be cut, axis and edges of every cell of ``d``."""
    stats = d.groupBy("_g", "_node").agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(f"d_{c}").alias(f"{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))],
        *[F.array_distinct(F.percentile_approx(f"d_{c}", _CUTS, 1_000)).alias(f"e_{c}") for c in cols])
    # an edge is a donor's value below the largest, so no part is empty
    def usable(c):
        return F.filter(f"e_{c}", lambda e: e < F.col(f"hi_{c}"))

    edges = [usable(c) for c in cols]
    stats = stats.withColumns({f"s_{i}": F.when(F.size(e) > 0, F.size(e)).otherwise(0) for i, e in enumerate(edges)})
    best = F.greatest(*[F.col(f"s_{i}") for i in range(len(cols))]) if len(cols) > 1 else F.col("s_0")
    axis = F.when((F.col("_n") > target) & (best > 0), F.coalesce(*[F.when(F.col(f"s_{i}") == best, i) for i in range(len(cols))]))
    stats = stats.withColumn("_axis", axis)
    cut = F.coalesce(*[F.when(F.col("_axis") == i, F.array_sort(e)) for i, e in enumerate(edges)])
    return stats.select("_g", "_node", "_n", "_axis", cut.alias("_edges"), *[f"{p}_{c}" for c in cols for p in ("lo", "hi")])


def _grow(d: DataFrame, cols: Sequence[str], target: int, held: Held) -> tuple[DataFrame, list[DataFrame]]:
    """(donors with their cell, cells of each level)."""
    whole = d.withColumn("_node", F.lit(1).cast("bigint"))
    open_, settled, levels = whole, [], []
    while True:
        cells = held.table(_cells(open_, cols, target))
        levels.append(cells)
        cut = cells.where(F.col("_axis").isNotNull())
        if not cut.limit(1).count():
            return reduce(DataFrame.union, [*settled, open_.select(whole.columns)]), levels
        goes_on = F.col("_axis").isNotNull()
        both = open_.join(cut.select("_g", "_node", "_axis", "_edges"), ["_g", "_node"], "left").withColumns(
            {"_on": goes_on, "_node": F.when(goes_on, _part("d_", cols)).otherwise(F.col("_node"))})
        both = held.table(both.select(*whole.columns, "_on"))
        settled.append(both.where(~F.col("_on")).select(whole.columns))
        open_ = both.where("_on").select(whole.columns)


def _box_distance(cols: Sequence[str], n: int, far: bool) -> Column:
    """Least (or ``far``: greatest) distance of a query to what a cell's box may
    hold, over the columns that query and donors share."""
    terms, shared = [], []
    for c in cols:
        q, lo, hi = F.col(f"q_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")
        side = F.greatest(F.abs(q - lo), F.abs(hi - q)) if far else F.greatest(lo - q, q - hi, F.lit(0.0))
        both = q.isNotNull() & lo.isNotNull()
        terms.append(F.when(both, side * side).otherwise(F.lit(0.0)))
        shared.append(both.cast("int"))
    m = sum(shared[1:], shared[0])
    return F.sqrt(F.lit(float(n)) / F.when(m > 0, m) * sum(terms[1:], terms[0]))  # NULL without a box


def _nearest(pairs: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    # ``row_number() <= k`` (not ``row_number() - 1 < k``) is planned as a
    # per-partition group limit before the shuffle
    w = Window.partitionBy(*by).orderBy("dist", "_dk")
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def _search(q_rows: DataFrame, d_rows: DataFrame, cols: list[str], k: int, n: int, target: int, held: Held) -> DataFrame:
    """``_qk, _dk, dist, nn_rank`` of the ``k`` nearest."""
    spark = q_rows.sparkSession
    vec = [f"q_{c}" for c in cols]
    # the smallest key of a distinct vector stands for it (partial aggregation)
    q = held.table(q_rows.groupBy(*vec).agg(F.min("_qk").alias("_qk")).withColumn("_p", _pattern("q_", cols)))
    d_rows = held.cache(d_rows.withColumn("_p", _pattern("d_", cols)))
    # gap patterns, not rows: one number for each set of present columns that occurs
    q_patterns, d_patterns = (sorted(r["_p"] for r in x.select("_p").distinct().collect()) for x in (q, d_rows))
    meet = [(qp, dp, qp & dp) for qp in q_patterns for dp in d_patterns if qp & dp]
    root = {pair: i for i, pair in enumerate(sorted({m[1:] for m in meet}))}
    of_donors = spark.createDataFrame([(dp, both, i) for (dp, both), i in root.items()], "_p bigint, _shared bigint, _g int")
    of_queries = spark.createDataFrame([(qp, root[dp, both]) for qp, dp, both in meet], "_p bigint, _g int")
    d_rows = d_rows.join(of_donors, "_p").withColumns({
        f"d_{c}": F.when(F.col("_shared").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"d_{c}")) for i, c in enumerate(cols)})
    same = Window.partitionBy("_g", *[f"d_{c}" for c in cols]).orderBy("_dk")
    d = held.table(d_rows.select("_g", "_dk", *[f"d_{c}" for c in cols])
                   .withColumn("_dup", F.row_number().over(same)).where(F.col("_dup") <= k).drop("_dup"))
    d, levels = _grow(d, cols, target, held)
    dist = nan_distance([F.col(f"q_{c}") for c in cols], [F.col(f"d_{c}") for c in cols], n)
    start = q.join(of_queries, "_p").drop("_p").withColumn("_node", F.lit(1).cast("bigint"))

    at = start
    for cells in levels[:-1]:
        cut = cells.where(F.col("_axis").isNotNull()).select("_g", "_node", "_axis", "_edges")
        at = at.join(cut, ["_g", "_node"], "left").withColumn(
            "_node", F.when(F.col("_axis").isNull(), F.col("_node")).otherwise(_part("q_", cols))).select(start.columns)
    at = held.table(at)
    own = _nearest(at.select("_qk", "_g", "_node", *vec).join(d, ["_g", "_node"]).select("_qk", "_g", "_dk", dist.alias("dist")), ["_qk", "_g"], k)
    near = own.groupBy("_qk", "_g").agg(F.count(F.lit(1)).alias("_cnt"), F.max("dist").alias("_far"))
    cut = reduce(DataFrame.union, levels).where(F.col("_axis").isNotNull())
    parent = cut.select("_g", F.col("_node").alias("_up"), *[f"{p}_{c}" for c in cols for p in ("lo", "hi")])
    bounds = (at.withColumn("_up", _above()).join(near, ["_qk", "_g"], "left")
              .join(parent, ["_g", "_up"], "left"))
    bound = F.when(F.col("_cnt") >= k, F.col("_far")).otherwise(F.coalesce(_box_distance(cols, n, True), F.lit(math.inf)))
    bounds = bounds.groupBy("_qk").agg((F.min(bound) * (1 + EPS_REL) + F.lit(1e-12)).alias("_rho"))

    front = start.join(bounds, "_qk").select(*start.columns, "_rho")
    met = []
    for level, cells in enumerate(levels):
        boxes = cells.select("_g", "_node", (F.col("_axis").isNotNull()).alias("_inner"), *[f"{p}_{c}" for c in cols for p in ("lo", "hi")])
        if level:  # the parts of the cells before
            boxes = boxes.withColumn("_up", _above())
            front = front.withColumnRenamed("_node", "_up").join(boxes, ["_g", "_up"])
        else:
            front = front.join(boxes, ["_g", "_node"])
        front = front.where(_box_distance(cols, n, False) <= F.col("_rho")).select(*start.columns, "_rho", "_inner")
        if level < len(levels) - 1:
            front = held.table(front)
        met.append(front.where(~F.col("_inner")))
        front = front.where("_inner").drop("_inner")
    pairs = reduce(DataFrame.union, met).join(d, ["_g", "_node"]).select("_qk", "_dk", dist.alias("dist"), "_rho")
    out = _nearest(pairs.where(F.col("dist") <= F.col("_rho")), ["_qk"], k).select(
        "_qk", "_dk", "dist", (F.col("_rn") - 1).alias("nn_rank"))
    per_vec = out.join(q.select("_qk", *vec), "_qk").drop("_qk")
    return join_groups(q_rows.select("_qk", *vec), per_vec, vec).select("_qk", "_dk", "dist", "nn_rank")


def _pattern(prefix: str, cols: list[str]) -> Column:
    """Bit ``i`` set where column ``i`` is present."""
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        out = out + F.when(F.col(f"{prefix}{c}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def knn_join(queries: DataFrame, donors: DataFrame, cols: Sequence[str], k: int,
             qkey: str = "key", dkey: str = "key", n_cols: int | None = None,
             exclude_self: bool = False, cell_target: int | None = None) -> DataFrame:
    """For each query row, its ``k`` nearest donors: ``q_key, d_key, dist, nn_rank``.

    Donors at undefined distance (no shared present column) are never chosen;
    a query without any such donor has no rows.  ``exclude_self`` drops the
    pair with equal keys (neighbours within one table).  Keys keep their types.
    """
    cols = list(cols)
    if len(cols) > 60:
        raise ValueError("knn_join takes at most 60 columns")
    kk = k + 1 if exclude_self else k
    held = Held()
    try:
        q = held.cache(queries.select(F.col(qkey).alias("_qk"), *[F.col(c).cast("double").alias(f"q_{c}") for c in cols]))
        d = donors.select(F.col(dkey).alias("_dk"), *[F.col(c).cast("double").alias(f"d_{c}") for c in cols])
        found = _search(q, d, cols, kk, n_cols or len(cols), cell_target or max(64 * kk, 512), held)
        if exclude_self:
            found = found.where(~F.col("_qk").eqNullSafe(F.col("_dk")))
        res = _nearest(found, ["_qk"], k).select(
            F.col("_qk").alias("q_key"), F.col("_dk").alias("d_key"), "dist", (F.col("_rn") - 1).cast("int").alias("nn_rank"))
        return cut_lineage(res)
    finally:
        held.release()
