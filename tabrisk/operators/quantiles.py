"""Exact quantiles that scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which does not survive a group of billions of rows.
``exact_quantiles`` returns the same linear-interpolated values
(numpy/pandas ``linear``, DuckDB ``quantile_cont``) by selection in rounds, for
groups of any size alike:

1. The bracket (two values) of each wanted rank starts as its group's ends, with
   a sketch of the values between.  A round takes the sketch's values around the
   rank as a bracket some hundred times smaller, and one scan counts the rows below
   it and in it and sketches those.
2. Rounds go on until a bracket holds at most ``limit`` rows or one value.  The
   counts are exact, so a bracket that misses its rank (a sketch may err) is seen,
   and the one before is kept and tallied as it is.
3. One scan tallies the values in the brackets - ties are aggregated before the
   shuffle - and a running count inside each picks the wanted ranks.

No sort or window holds more than about ``limit`` rows.  Groups may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.operators.ranking import _cols, join_groups
from tabrisk.session import cut_lineage

ACCURACY = 10_000      # of a sketch: its rank error is below 1 / accuracy
LIMIT = 1_000_000      # rows of a bracket that are tallied
STEPS = 500            # values a sketch is asked for


def _bracketed(vals: DataFrame, brackets: DataFrame, g: list[str]) -> DataFrame:
    """One row for each value and bracket that it lies in or below of: ``_i`` and
    ``_x``, NULL below."""
    per_group = brackets.groupBy(*g).agg(F.collect_list(F.struct("_i", "_low", "_high")).alias("_b"))
    near = F.filter("_b", lambda b: F.col("_v") <= b["_high"])
    hits = F.transform(near, lambda b: F.struct(b["_i"].alias("_i"), F.when(F.col("_v") >= b["_low"], F.col("_v")).alias("_x")))
    # a row per group: AQE broadcasts it when its measured size allows
    return join_groups(vals, per_group, g).select(*g, F.explode(hits).alias("_h")).select(*g, "_h._i", "_h._x")


def _sketch(x: str, accuracy: int) -> Column:
    return F.percentile_approx(x, [k / STEPS for k in range(STEPS + 1)], accuracy)


def _narrowed(brackets: DataFrame, accuracy: int) -> DataFrame:
    """Brackets with the sketch's values around their ranks as ``_low`` and ``_high``."""
    margin = max(2, -(-3 * STEPS // accuracy))
    at = lambda r: (F.col(r) - F.col("_below")) / F.greatest(F.col("_in") - 1, F.lit(1)) * STEPS
    low = F.element_at("_grid", (F.greatest(F.floor(at("_r0")) - margin, F.lit(0)) + 1).cast("int"))
    high = F.element_at("_grid", (F.least(F.ceil(at("_r1")) + margin, F.lit(STEPS)) + 1).cast("int"))
    return brackets.withColumns({"_low": F.greatest("_low", low), "_high": F.least("_high", high)})


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols=None,
                    accuracy: int = ACCURACY, limit: int = LIMIT) -> DataFrame:
    """Rows ``(*group_cols, q_index, prob, quantile)``; NULL values are skipped.

    ``q_index`` is the position of the probability in ``probs``.
    """
    g = _cols(group_cols)
    ungrouped = not g
    if ungrouped:
        df, g = df.withColumn("_g", F.lit(0)), ["_g"]
    vals = (df.select(*g, F.col(value_col).cast("double").alias("_v"))
            .where(F.col("_v").isNotNull()))
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probs)])
    groups = cut_lineage(vals.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), _sketch("_v", accuracy).alias("_grid")))
    rank = F.floor((F.col("_n") - 1) * F.col("_w._p"))
    state = ["_low", "_high", "_below", "_in", "_grid"]
    brackets = groups.withColumn("_w", F.explode(wanted)).select(
        *g, F.col("_w._i").alias("_i"), rank.alias("_r0"), F.least(rank + 1, F.col("_n") - 1).alias("_r1"),
        F.col("_min").alias("_low"), F.col("_max").alias("_high"), F.lit(0).cast("bigint").alias("_below"),
        F.col("_n").alias("_in"), "_grid", F.lit(False).alias("_stop"))
    while True:
        wide = (F.col("_in") > limit) & (F.col("_low") < F.col("_high")) & ~F.col("_stop")
        todo = brackets.where(wide)
        if not todo.limit(1).count():
            break
        step = _narrowed(todo, accuracy).select(*g, "_i", "_low", "_high")
        seen = _bracketed(vals, step, g).groupBy(*g, "_i").agg(
            F.count_if(F.col("_x").isNull()).alias("_below"), F.count("_x").alias("_in"), _sketch("_x", accuracy).alias("_grid"))
        new = join_groups(step, seen, [*g, "_i"]).withColumnsRenamed({c: f"_new{c}" for c in state})
        both = join_groups(todo, new, [*g, "_i"], "left")
        hit = F.coalesce((F.col("_r0") >= F.col("_new_below")) & (F.col("_r1") < F.col("_new_below") + F.col("_new_in")), F.lit(False))
        less = both.select(*g, "_i", "_r0", "_r1", *[F.when(hit, F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) for c in state],
                           (~hit | (F.col("_new_in") >= F.col("_in"))).alias("_stop"))
        brackets = cut_lineage(brackets.where(~wide).unionByName(less))
    tally = (_bracketed(vals, brackets, g).where(F.col("_x").isNotNull())
             .groupBy(*g, "_i", "_x").agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy(*g, "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    cum = tally.withColumn("_lo", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    both = join_groups(cum, brackets.select(*g, "_i", "_r0", "_r1", "_below"), [*g, "_i"])

    def at(r):
        place = F.col(r) - F.col("_below")
        return F.max(F.when((F.col("_lo") <= place) & (place < F.col("_lo") + F.col("_c")), F.col("_x")))

    ranks = both.groupBy(*g, "_i").agg(at("_r0").alias("_x0"), at("_r1").alias("_x1"))
    ranks = join_groups(ranks, groups.select(*g, "_n"), g)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    h = (F.col("_n") - 1) * prob
    res = ranks.select(*g, F.col("_i").cast("int").alias("q_index"), prob.alias("prob"),
                       (F.col("_x0") + (h - F.floor(h)) * (F.col("_x1") - F.col("_x0"))).alias("quantile"))
    return res.drop("_g") if ungrouped else res


def quantile_array(df: DataFrame, value_col: str, probs: Sequence[float], group_cols=None,
                   name: str = "quantiles") -> DataFrame:
    """Quantiles of each group collected into an array ordered like ``probs``."""
    g = _cols(group_cols)
    q = exact_quantiles(df, value_col, probs, g)
    return q.groupBy(*g).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q_index", "quantile"))),
                    lambda s: s["quantile"]).alias(name))
