"""Node tables: rewriting, derived candidates, importances, trees in groups."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.operators import explain, forest, metrics, nodes
from tabrisk.sources import io

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(500).select(
        F.col("id").alias("key"), (F.col("id") % 11).cast("double").alias("a"),
        ((F.col("id") * 31) % 17).cast("double").alias("b"), ((F.col("id") * 13) % 5).cast("double").alias("c"),
        (((F.col("id") % 11) + (F.col("id") * 31) % 17 + (F.col("id") * 7919) % 6) > 14).cast("int").alias("y"))
    return metrics.with_folds(df, "y", "key", 3).cache()


@pytest.fixture(scope="module")
def model(table):
    return forest.fit_forest(table, FEATS, "y", {"n_estimators": 7, "max_depth": 8})


def trees(rows):
    out = {}
    for r in rows:
        out.setdefault(r["tree_id"], {})[r["node_id"]] = r
    return out


def walk(tree, x, depth=99, split=0):
    """Value of the node a row ends in, cut by depth and split bound."""
    at, level = min(tree), 0
    while tree[at]["left"] >= 0 and level < depth and tree[at]["cover"] >= split:
        at = tree[at]["left"] if x[tree[at]["feature"]] <= tree[at]["threshold"] else tree[at]["right"]
        level += 1
    return tree[at]["value"]


def test_depths(model):
    got = nodes.with_depth(nodes.forest_nodes(model)).collect()
    for tree in trees(got).values():
        want = {min(tree): 0}
        for i in sorted(tree):
            for side in ("left", "right"):
                if tree[i]["left"] >= 0:
                    want[tree[i][side]] = want[i] + 1
        assert want == {i: r["depth"] for i, r in tree.items()}


@pytest.mark.parametrize("split, depth, n", [(2, None, None), (20, None, None), (2, 3, 4), (60, 5, 2), (2, 0, 1), (10 ** 6, None, None)])
def test_pruned_tables_score_like_cut_descents(table, model, split, depth, n):
    full = nodes.forest_nodes(model)
    cut = nodes.prune(full, split, depth, n)
    whole, small = trees(full.collect()), trees(cut.collect())
    assert len(small) == (n or 7) and cut.columns == full.columns
    for t, tree in small.items():
        for r in tree.values():
            assert (r["left"] < 0) or r["cover"] >= split
            assert r["left"] < 0 or {r["left"], r["right"]} <= set(tree)
            assert (r["value"], r["cover"]) == (whole[t][r["node_id"]]["value"], whole[t][r["node_id"]]["cover"])
    xs = [(r.key, (r.a, r.b, r.c)) for r in table.limit(40).collect()]
    got = {r.key: r.probs for r in nodes.score_candidates(table, full, FEATS, [(n or 7, 99 if depth is None else depth, split)]).collect()}
    for key, x in xs:
        want = [walk(whole[t], x, 99 if depth is None else depth, split) for t in range(n or 7)]
        assert want == [walk(small[t], x) for t in range(n or 7)]
        assert got[key][0] == pytest.approx(np.mean(want), abs=1e-12)


def test_trees_in_groups_give_the_same(table, model):
    full = nodes.forest_nodes(model)
    one = {r.key: r for r in explain.tree_shap(table, full, FEATS, "key").collect()}
    many = explain.tree_shap(table, full, FEATS, "key", group_bytes=20_000, rows_per_block=100)
    assert many.count() == len(one)
    for r in many.collect():
        assert np.allclose(r.shap, one[r.key].shap, atol=1e-12) and r.prediction == pytest.approx(one[r.key].prediction)
        assert r.base_value == pytest.approx(one[r.key].base_value)
    cands = [(7, 30, 2), (3, 2, 40)]
    a = {r.key: r.probs for r in nodes.score_candidates(table, full, FEATS, cands).collect()}
    b = {r.key: r.probs for r in nodes.score_candidates(table, full, FEATS, cands, group_bytes=30_000, rows_per_block=64).collect()}
    assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a) and len(a) == len(b)


def test_importances_of_a_node_table(table, model):
    want = model.featureImportances.toArray()
    got = {r.pos: r.importance for r in nodes.node_importances(nodes.forest_nodes(model), 3).collect()}
    assert np.allclose([got[i] for i in range(3)], want, atol=1e-9)


def test_split_bound_is_kept_everywhere(spark, table, tmp_path):
    params = {"n_estimators": 4, "max_depth": 6, "min_samples_split": 50}
    model = forest.fit_forest(table, FEATS, "y", params)
    assert isinstance(model, forest.NodeForest)
    own = model.nodes.where("left >= 0")
    assert own.where("cover < 50").count() == 0 < own.count()
    assert forest.forest_nodes(model.model).where("left >= 0 AND cover < 50").count() > 0
    io.save_model(spark, model, str(tmp_path / "m"), FEATS, params)
    back, feats, kept = io.load_model(spark, str(tmp_path / "m"))
    assert feats == FEATS and kept == params
    a = {r.key: (r.prob, r.pred) for r in forest.predict(table, model, FEATS).collect()}
    b = {r.key: (r.prob, r.pred) for r in forest.predict(table, back, FEATS).collect()}
    assert a.keys() == b.keys() and all(a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0]) for k in a)
    assert sum(r.importance for r in forest.feature_importance(spark, model, FEATS).collect()) == pytest.approx(1)
    assert forest.cross_validate(table, FEATS, "y", params, "fold", 3).agg(F.sum("n")).first()[0] == 500


def test_the_whole_grid_has_48_candidates():
    assert len(forest.expand_grid(forest.DEFAULT_GRID)) == 48
    # two leaf sizes and, of ten features, one number of them
    assert len(forest._families(forest.expand_grid(forest.DEFAULT_GRID), 10)) == 2


def test_search_scores_parts_like_their_tables(spark, table):
    grid = {"n_estimators": [3, 6], "max_depth": [2, None], "min_samples_split": [2, 30], "min_samples_leaf": [1, 5]}
    best, got = forest.grid_search(spark, table, FEATS, "y", grid, "fold", 3)
    rows = got.orderBy("candidate").collect()
    assert [json.loads(r.params) for r in rows] == forest.expand_grid(grid)
    assert max(r.mean_recall for r in rows) == next(r.mean_recall for r in rows if json.loads(r.params) == best)
    for r in rows:  # the same forests, cut as tables
        c = json.loads(r.params)
        recalls = []
        for i in range(3):
            big = {**c, "n_estimators": 6, "max_depth": None, "min_samples_split": 2}
            full = forest.forest_nodes(forest.fit_forest(table.where(F.col("fold") != i), FEATS, "y", big))
            cut = nodes.prune(full, forest.split_bound(c), c["max_depth"], c["n_estimators"])
            held = table.where((F.col("fold") == i) & (F.col("y") == 1))
            scored = nodes.score_candidates(held, cut, FEATS, [(c["n_estimators"], 99, 0)])
            recalls.append(scored.agg(F.avg((F.col("probs")[0] > 0.5).cast("int"))).first()[0])
        assert np.allclose(r.fold_recall, recalls)
        if r.candidate >= 2:
            break
