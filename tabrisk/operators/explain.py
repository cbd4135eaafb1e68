"""Attributions: tree SHAP for forests, the exact linear case, and the
attribution tables built from them.

Tree SHAP (path-dependent, no background data) for a leaf with value ``v``
and the distinct features ``F`` on its path: with ``z_i`` the product of the
cover ratios of the splits on ``i`` and ``o_i`` whether the row passes all of
them, the leaf adds ``v (o_j - z_j)`` times the integral over ``t`` in [0, 1] of
``prod_{i != j} ((1 - t) z_i + t o_i)`` to feature ``j``; the base value is
``sum v prod z_i``.  Trees are averaged, as the forest averages their class-1
fractions.

Leaf paths are packed by groups of trees and meet the rows in
``nodes.sum_over_trees``: broadcast if they are one group of bounded size, else
joined with blocks of rows, the partial attributions summed.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.operators.nodes import GROUP_BYTES, NODE_SCHEMA, ROWS_PER_BLOCK, forest_nodes, sum_over_trees

# Functions that run in Python workers are shipped by value, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def stump_nodes(df: DataFrame, feature: str, feature_index: int, label: str,
                threshold: Column) -> DataFrame:
    """A one-split tree fitted by aggregation: leaf values are class-1 shares.

    ``threshold`` is any scalar expression over ``df`` aggregates (e.g. the mean).
    """
    t = df.agg(threshold.alias("_t")).withColumn("_k", F.lit(1))
    x = df.select(F.col(feature).cast("double").alias("_x"), F.col(label).cast("double").alias("_y"),
                  F.lit(1).alias("_k")).join(F.broadcast(t), "_k")
    left = F.col("_x") <= F.col("_t")
    a = x.agg(F.first("_t").alias("t"), F.count(F.lit(1)).cast("double").alias("n"),
              F.count_if(left).cast("double").alias("nl"), F.sum(F.when(left, F.col("_y"))).alias("pl"),
              F.sum(F.when(~left, F.col("_y"))).alias("pr"), F.sum("_y").alias("p"))
    nr = F.col("n") - F.col("nl")

    def node(i, l, r, f, thr, val, cov):
        return F.struct(F.lit(0).alias("tree_id"), F.lit(i).alias("node_id"), F.lit(l).alias("left"),
                        F.lit(r).alias("right"), F.lit(f).alias("feature"), thr.cast("double").alias("threshold"),
                        F.array().cast("array<double>").alias("categories"), F.lit(-1).alias("num_categories"),
                        val.cast("double").alias("value"), cov.cast("double").alias("cover"))

    rows = F.array(
        node(0, 1, 2, feature_index, F.col("t"), F.col("p") / F.col("n"), F.col("n")),
        node(1, -1, -1, -1, F.lit(None), F.coalesce(F.col("pl") / F.col("nl"), F.lit(0.0)), F.col("nl")),
        node(2, -1, -1, -1, F.lit(None), F.coalesce(F.col("pr") / nr, F.lit(0.0)), nr))
    return a.select(F.explode(rows).alias("n")).select("n.*")


def _flat_paths(nodes: list) -> tuple:
    """All leaf paths of some trees as flat arrays.

    (base value, blocks): a block holds the leaves whose paths have the
    same number ``m`` of distinct features - values (leaves), features and cover
    shares (leaves x m) - and per leaf and feature the tests on its path, padded.
    """
    by_tree: dict[int, dict[int, dict]] = defaultdict(dict)
    for r in nodes:
        by_tree[r["tree_id"]][r["node_id"]] = r
    groups: dict[int, list] = defaultdict(list)
    base = 0.0
    for tn in by_tree.values():
        stack = [(min(tn), {})]
        while stack:
            nid, path = stack.pop()
            nd = tn[nid]
            if nd["left"] is None or nd["left"] < 0:
                value = float(nd["value"])
                base += value * math.prod(z for z, _, _ in path.values())
                groups[len(path)].append((value, path))
                continue
            f, cover = int(nd["feature"]), float(nd["cover"]) or 1.0
            cat = nd["num_categories"] is not None and nd["num_categories"] >= 0
            for child, go_left in ((nd["left"], True), (nd["right"], False)):
                z, span, sets = path.get(f, (1.0, (-math.inf, math.inf), ()))
                if cat:
                    sets = (*sets, (tuple(nd["categories"] or ()), go_left))
                elif go_left:
                    span = (span[0], min(span[1], float(nd["threshold"])))
                else:
                    span = (max(span[0], float(nd["threshold"])), span[1])
                stack.append((child, {**path, f: (z * float(tn[child]["cover"]) / cover, span, sets)}))
    blocks = []
    for m, leaves in groups.items():
        names = [sorted(p) for _, p in leaves]
        blocks.append((
            np.array([v for v, _ in leaves]), np.array(names, dtype=np.int32).reshape(len(leaves), m),
            np.array([[p[f][0] for f in n] for (_, p), n in zip(leaves, names)]).reshape(len(leaves), m),
            np.array([[p[f][1] for f in n] for (_, p), n in zip(leaves, names)]).reshape(len(leaves), m, 2),
            {(i, j): p[f][2] for i, ((_, p), n) in enumerate(zip(leaves, names)) for j, f in enumerate(n) if p[f][2]}))
    return base, blocks


ROWS_LEAVES = 200_000  # rows x leaves evaluated at once


def _tree_shap_batch(x: np.ndarray, paths: tuple, p: int):
    """Attributions, prediction and base value of a batch of rows, summed over the trees.

    The Shapley sum over the subsets of a path's features is the integral over
    ``t`` in [0, 1] of ``prod((1 - t) z + t o)`` without the feature itself, a
    polynomial, so Gauss-Legendre quadrature with enough points is exact.  The
    product without a feature is the whole product divided by its factor, which is
    above 0 inside the interval: the work is linear in the path length.
    """
    base, blocks = paths
    phi, pred = np.zeros((len(x), p)), np.zeros(len(x))
    for value, feats, z, span, sets in blocks:
        m = feats.shape[1]
        if m == 0:
            pred += value.sum()
            continue
        nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        nodes, weights = (nodes + 1) / 2, weights / 2
        step = max(1, ROWS_LEAVES // max(1, len(x)))
        for a in range(0, len(value), step):
            v, f, zz = value[a:a + step], feats[a:a + step], z[a:a + step]
            own = x[:, f]                                        # rows x leaves x m
            one = (own > span[a:a + step, :, 0]) & (own <= span[a:a + step, :, 1])
            for (i, j), tests in sets.items():
                if a <= i < a + step:
                    for inside, go_left in tests:
                        one[:, i - a, j] &= np.isin(x[:, feats[i, j]], inside) == go_left
            pred += one.all(2) @ v
            total = np.zeros(one.shape)
            for t, w in zip(nodes, weights):
                factor = (1 - t) * zz + t * one
                total += w * factor.prod(2, keepdims=True) / factor
            total *= v[None, :, None] * (one - zz)
            flat = f.ravel()
            order = np.argsort(flat, kind="stable")
            names, first = np.unique(flat[order], return_index=True)
            phi[:, names] += np.add.reduceat(total.reshape(len(x), -1)[:, order], first, axis=1)
    return np.column_stack([phi, pred, np.full(len(x), base)])


def tree_shap(df: DataFrame, nodes: DataFrame, features: Sequence[str], key: str,
              group_bytes: int = GROUP_BYTES, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``key, base_value, prediction, shap`` (array in feature order) per row, for a
    model of any size; ``group_bytes`` bounds the part of it one task holds."""
    p = len(features)
    trees = max(1, nodes.select("tree_id").distinct().count())
    out = sum_over_trees(df.select(key, *features), nodes, features, _flat_paths, lambda paths, x: _tree_shap_batch(x, paths, p),
                         p + 2, "_sums", group_bytes, rows_per_block)
    mean = F.transform("_sums", lambda v: v / F.lit(float(trees)))
    return out.select(key, mean[p + 1].alias("base_value"), mean[p].alias("prediction"), F.slice(mean, 1, p).alias("shap"))


def linear_shap(df: DataFrame, key: str, weights: Mapping[str, float], intercept: float = 0.0,
                means: Mapping[str, float] | None = None) -> DataFrame:
    """Exact attributions of ``intercept + sum w_j x_j`` with independent features:
    ``w_j (x_j - mean_j)``; a pure projection."""
    feats = list(weights)
    means = means or {c: 0.0 for c in feats}
    base = intercept + sum(weights[c] * means[c] for c in feats)
    shap = F.array(*[(F.lit(weights[c]) * (F.col(c).cast("double") - F.lit(means[c]))) for c in feats])
    pred = F.lit(intercept)
    for c in feats:
        pred = pred + F.lit(weights[c]) * F.col(c).cast("double")
    return df.select(key, F.lit(base).alias("base_value"), pred.alias("prediction"), shap.alias("shap"))


def attributions(shap: DataFrame, scaled: DataFrame, display: DataFrame, key: str,
                 features: Sequence[str]) -> DataFrame:
    """Long table ``key, feature_pos, feature, value_scaled, value_original, shap_value, abs_shap``.

    Twin rows are aligned by key (never by position); values are attached by
    array position, so there is one join per twin table and no unpivot join.
    """
    feats = list(features)
    names = F.array(*[F.lit(c) for c in feats])
    sc = scaled.select(key, F.array(*[F.col(c).cast("double") for c in feats]).alias("_sv"))
    dp = display.select(key, F.array(*[F.col(c).cast("double") for c in feats]).alias("_dv"))
    wide = shap.select(key, "shap").join(sc, key).join(dp, key, "left")
    long = wide.select(key, "_sv", "_dv", F.posexplode("shap").alias("feature_pos", "shap_value"))
    i = F.col("feature_pos") + 1
    return long.select(
        key, F.col("feature_pos").cast("int").alias("feature_pos"),
        F.element_at(names, i).alias("feature"),
        F.element_at("_sv", i).alias("value_scaled"),
        F.element_at("_dv", i).alias("value_original"),
        "shap_value", F.abs("shap_value").alias("abs_shap"))


def top_reasons(shap: DataFrame, key: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """Per row the ``k`` largest positive attributions (fewer if fewer are positive).

    Computed on the row's attribution array (sort within the row), so there
    is no shuffle: ``key, reason_rank, feature_pos, feature, shap_value``.
    """
    names = F.array(*[F.lit(c) for c in features])
    pairs = F.transform("shap", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    positive = F.filter(pairs, lambda s: s["v"] > 0)
    ordered = F.array_sort(positive, lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1)
                           .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    top = F.slice(ordered, 1, k)
    out = shap.select(key, F.posexplode(top).alias("reason_rank", "r"))
    return out.select(key, (F.col("reason_rank") + 1).cast("int").alias("reason_rank"),
                      F.col("r.i").cast("int").alias("feature_pos"),
                      F.element_at(names, F.col("r.i") + 1).alias("feature"),
                      F.col("r.v").alias("shap_value"))


def sorted_attributions(attr: DataFrame, key: str) -> DataFrame:
    """Attributions ranked by |shap| descending (ties by feature position), per row."""
    w = Window.partitionBy(key).orderBy(F.desc("abs_shap"), "feature_pos")
    return attr.withColumn("impact_rank", F.row_number().over(w).cast("int"))
