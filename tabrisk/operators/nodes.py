"""Forests as node tables: reading, rewriting, scoring, importances.

A node table (``NODE_SCHEMA``) has one row a node; its size follows the model,
and nothing here collects it.  Rewriting is joins on the table:

* ``prune`` makes a leaf of every node whose cover is below
  ``min_samples_split`` or whose depth is ``max_depth``, and drops what hangs
  below; covers fall along a path, so a node stays exactly if its parent splits.
* depths come from pointer doubling: five self-joins reach Spark's deepest tree.

So one fitted forest holds every forest that is shallower, has fewer trees or
splits fewer nodes, and ``score_candidates`` scores all of them in one descent.

``sum_over_trees`` evaluates rows against trees.  Trees are dealt to groups of
bounded size and every group is packed by one task.  A single group is
broadcast; otherwise blocks of rows meet groups of trees in a cogroup, and the
partial sums of a row are added up.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.session import checkpoint_dir, cut_lineage

# Functions that run in Python workers are shipped by value, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = ("tree_id int, node_id int, left int, right int, feature int, threshold double, "
               "categories array<double>, num_categories int, value double, cover double")
NODE_BYTES = 600             # of a node and its share of the leaf paths
GROUP_BYTES = 256 << 20      # of a group of trees
ROWS_PER_BLOCK = 200_000     # rows that meet a group of trees in one task
DOUBLINGS = 5                # 2 ** 5 > Spark's deepest tree


def forest_nodes(model) -> DataFrame:
    """The forest as a node table, read from its saved form.

    The model is written under the session's checkpoint folder (shared
    storage on a cluster) and its parquet node data read back as a DataFrame.
    ``value`` is the class-1 share of a node, ``cover`` its training weight.
    """
    if isinstance(model, NodeForest):
        return model.nodes
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    nd = F.col("nodeData")
    stats = nd["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    pos = F.coalesce(F.try_element_at(stats, F.lit(2)), F.lit(0.0))
    return raw.select(
        F.col("treeID").cast("int").alias("tree_id"), nd["id"].alias("node_id"),
        nd["leftChild"].alias("left"), nd["rightChild"].alias("right"),
        nd["split"]["featureIndex"].alias("feature"),
        F.try_element_at(nd["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        nd["split"]["leftCategoriesOrThreshold"].alias("categories"),
        nd["split"]["numCategories"].alias("num_categories"),
        F.when(total > 0, pos / total).otherwise(F.lit(0.0)).alias("value"),
        total.alias("cover"))


def _inner() -> Column:
    return F.col("left") >= 0


def _parents(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, parent, parent_cover`` of every node but the roots."""
    return nodes.where(_inner()).select(
        "tree_id", F.explode(F.array("left", "right")).alias("node_id"), F.col("node_id").alias("parent"),
        F.col("cover").alias("parent_cover"))


def with_depth(nodes: DataFrame, name: str = "depth") -> DataFrame:
    """Add each node's distance from its root."""
    up = nodes.select("tree_id", "node_id").join(
        _parents(nodes).select("tree_id", "node_id", F.col("parent").alias("_up")), ["tree_id", "node_id"], "left")
    up = up.withColumn("_far", F.col("_up").isNotNull().cast("int"))
    for _ in range(DOUBLINGS):  # _up is _far steps above, NULL above the root
        above = up.select("tree_id", F.col("node_id").alias("_up"), F.col("_up").alias("_up2"), F.col("_far").alias("_far2"))
        up = up.join(above, ["tree_id", "_up"], "left").select(
            "tree_id", "node_id", F.col("_up2").alias("_up"), (F.col("_far") + F.coalesce("_far2", F.lit(0))).alias("_far"))
    return nodes.join(up.select("tree_id", "node_id", F.col("_far").alias(name)), ["tree_id", "node_id"])


def prune(nodes: DataFrame, min_samples_split: int = 2, max_depth: int | None = None,
          n_trees: int | None = None) -> DataFrame:
    """The node table of the smaller forest (same columns).

    ``min_samples_split`` counts a node's bootstrap rows (its cover).
    """
    columns = nodes.columns
    if n_trees is not None:
        nodes = nodes.where(F.col("tree_id") < n_trees)
    if max_depth is None:
        shut = F.col("cover") < min_samples_split
        above = F.col("parent_cover") >= min_samples_split
    else:
        nodes = with_depth(nodes, "_depth")
        shut = (F.col("cover") < min_samples_split) | (F.col("_depth") >= max_depth)
        above = (F.col("parent_cover") >= min_samples_split) & (F.col("_depth") <= max_depth)
    keep = nodes.join(_parents(nodes), ["tree_id", "node_id"], "left").where(F.col("parent").isNull() | above)
    leaf = {"left": F.lit(-1), "right": F.lit(-1), "feature": F.lit(-1), "threshold": F.lit(None).cast("double"),
            "categories": F.array().cast("array<double>"), "num_categories": F.lit(-1)}
    return keep.select([F.when(shut, leaf[c]).otherwise(F.col(c)).alias(c) if c in leaf else F.col(c) for c in columns])


def node_importances(nodes: DataFrame, n_features: int) -> DataFrame:
    """``pos, importance``: decrease of the Gini impurity by feature, normalised
    per tree and over the forest; features without a split have 0."""
    gini = lambda v: 2 * F.col(v) * (1 - F.col(v))
    sides = nodes.where(_inner()).select(
        "tree_id", "feature", (F.col("cover") * gini("value")).alias("_own"), F.explode(F.array("left", "right")).alias("_child"))
    child = nodes.select("tree_id", F.col("node_id").alias("_child"), (F.col("cover") * gini("value")).alias("_below"))
    # every split comes in twice, once with each child
    gains = sides.join(child, ["tree_id", "_child"]).groupBy("tree_id", "feature").agg(
        F.sum(F.col("_own") / 2 - F.col("_below")).alias("_gain"))
    per_tree = gains.groupBy("tree_id").agg(F.sum("_gain").alias("_all"))
    share = gains.join(per_tree, "tree_id").where(F.col("_all") > 0).groupBy("feature").agg(
        F.sum(F.col("_gain") / F.col("_all")).alias("_share"))
    total = share.agg(F.sum("_share").alias("_total"))  # one row
    pos = nodes.sparkSession.range(n_features).select(F.col("id").cast("int").alias("pos"))
    return pos.join(share, F.col("pos") == F.col("feature"), "left").join(F.broadcast(total)).select(
        "pos", F.coalesce(F.col("_share") / F.col("_total"), F.lit(0.0)).alias("importance"))


# ---- rows against trees --------------------------------------------------------

def sum_over_trees(df: DataFrame, nodes: DataFrame, features: Sequence[str], pack: Callable[[list[dict]], Any],
                   evaluate: Callable[[Any, np.ndarray], np.ndarray], width: int, name: str,
                   group_bytes: int = GROUP_BYTES, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with the array ``name``: ``evaluate(pack(nodes of some trees), x)``,
    ``width`` numbers a row, summed over all trees."""
    size = nodes.count() * NODE_BYTES
    groups = max(1, -(-size // group_bytes))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_group": [int(pdf["_group"].iloc[0])], "_trees": [pickle.dumps(pack(pdf.to_dict("records")))]})

    trees = nodes.withColumn("_group", F.pmod("tree_id", F.lit(groups))).groupBy("_group").applyInPandas(
        packed, "_group int, _trees binary")
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.withColumn("_x", x)

    def values(trees, column) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), len(features))
        out = evaluate(trees, flat)
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(out, float).ravel()), width).cast(pa.list_(pa.float64()))

    if groups == 1:
        # one row of at most about group_bytes
        payload = df.sparkSession.sparkContext.broadcast([pickle.loads(r["_trees"]) for r in trees.collect()])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    zero = pa.array([[0.0] * width] * batch.num_rows, pa.list_(pa.float64()))
                    got = values(payload.value[0], batch.column("_x")) if payload.value else zero
                    yield batch.append_column(name, got)

        schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(run, schema).drop("_x")

    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // rows_per_block))
    left = rows.select("_row", "_x", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    right = cut_lineage(trees).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(own: pa.Table, group: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        if not own.num_rows or not group.num_rows:
            return pa.table({"_row": pa.array([], pa.int64()), "_v": pa.array([], pa.list_(pa.float64()))})
        column = own.column("_x").combine_chunks()
        return pa.table({"_row": own.column("_row"), "_v": values(pickle.loads(group.column("_trees")[0].as_py()), column)})

    parts = left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(
        meet, "_row bigint, _v array<double>")
    sums = parts.groupBy("_row").agg(F.array(*[F.sum(F.col("_v")[i]) for i in range(width)]).alias(name))
    return rows.join(sums, "_row").drop("_row", "_x")


def _flat_trees(nodes: list[dict]) -> SimpleNamespace:
    """Trees as flat arrays, for descending many rows at once."""
    nodes = sorted(nodes, key=lambda r: (r["tree_id"], r["node_id"]))
    place = {(r["tree_id"], r["node_id"]): i for i, r in enumerate(nodes)}
    leaf = np.array([not r["left"] >= 0 for r in nodes])
    left, right = (np.array([i if leaf[i] else place[r["tree_id"], r[side]] for i, r in enumerate(nodes)]) for side in ("left", "right"))
    below = {*left[~leaf].tolist(), *right[~leaf].tolist()}
    roots = np.array([i for i in range(len(nodes)) if i not in below])
    return SimpleNamespace(
        leaf=leaf, left=left, right=right, roots=roots, trees=np.array([nodes[i]["tree_id"] for i in roots]),
        feature=np.array([0 if leaf[i] else int(r["feature"]) for i, r in enumerate(nodes)]),
        threshold=np.array([0.0 if leaf[i] or r["threshold"] is None else r["threshold"] for i, r in enumerate(nodes)], float),
        value=np.array([r["value"] for r in nodes], float), cover=np.array([r["cover"] for r in nodes], float),
        sets={i: list(r["categories"]) for i, r in enumerate(nodes) if not leaf[i] and r["num_categories"] >= 0})


def _step(trees: SimpleNamespace, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nodes after ``at`` (rows x trees)."""
    own = x[np.arange(len(x))[:, None], trees.feature[at]]
    left = own <= trees.threshold[at]
    for i, inside in trees.sets.items():
        here = at == i
        if here.any():
            left[here] = np.isin(own[here], inside)
    return np.where(left, trees.left[at], trees.right[at])


def score_candidates(df: DataFrame, nodes: DataFrame, features: Sequence[str],
                     candidates: Sequence[tuple[int, int, int]], name: str = "probs", **limits) -> DataFrame:
    """``df`` with an array of class-1 probabilities, one for each candidate
    ``(n_trees, max_depth, min_samples_split)`` cut out of the forest."""
    cuts = sorted({c[1:] for c in candidates})

    def evaluate(trees: SimpleNamespace, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(candidates)))
        for a in range(0, len(x), 2_000):
            own = x[a:a + 2_000]
            at = np.broadcast_to(trees.roots, (len(own), len(trees.roots)))
            value = {c: np.zeros(at.shape) for c in cuts}
            open_ = {c: np.ones(at.shape, bool) for c in cuts}
            depth = 0
            while any(o.any() for o in open_.values()):
                for c in cuts:
                    stop = open_[c] & (trees.leaf[at] | (depth >= c[0]) | (trees.cover[at] < c[1]))
                    value[c][stop] = trees.value[at][stop]
                    open_[c] &= ~stop
                at, depth = _step(trees, at, own), depth + 1
            for k, (n, *cut) in enumerate(candidates):
                out[a:a + 2_000, k] = value[tuple(cut)][:, trees.trees < n].sum(1)
        return out

    scored = sum_over_trees(df, nodes, features, _flat_trees, evaluate, len(candidates), name, **limits)
    return scored.withColumn(name, F.array(*[F.col(name)[k] / F.lit(float(c[0])) for k, c in enumerate(candidates)]))


@dataclass
class NodeForest:
    """A forest that is a node table: a fitted model after :func:`prune`."""

    model: Any                # Spark's model before
    nodes: DataFrame
    n_trees: int
    min_samples_split: int

    @staticmethod
    def of(model, min_samples_split: int) -> "NodeForest":
        nodes = cut_lineage(prune(forest_nodes(model), min_samples_split))
        return NodeForest(model, nodes, model.getNumTrees, min_samples_split)

    def probability(self, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
        whole = [(self.n_trees, 2 ** DOUBLINGS, 0)]
        scored = score_candidates(df, self.nodes, features, whole, "_probs")
        return scored.withColumn(name, F.col("_probs")[0]).drop("_probs")
