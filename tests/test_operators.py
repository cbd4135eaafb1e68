"""Operators against brute force on small random fixtures, including a value
held by a third of the rows (the skew case every operator must survive)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.operators import encode, explain, forest, impute, knn, metrics, quantiles, ranking, smote


def _brute_knn(q, d, k, exclude_self=False):
    out = {}
    n = q.shape[1] - 1
    for qr in q:
        cands = []
        for dr in d:
            if exclude_self and qr[0] == dr[0]:
                continue
            both = ~np.isnan(qr[1:]) & ~np.isnan(dr[1:])
            m = both.sum()
            if m == 0:
                continue
            dist = math.sqrt(n / m * float(((qr[1:] - dr[1:])[both] ** 2).sum()))
            cands.append((dist, int(dr[0])))
        cands.sort()
        out[int(qr[0])] = cands[:k]
    return out


def _table(spark, rng, n, heavy_share=1 / 3, null_share=0.1, start=0):
    a = rng.normal(size=n).round(2)
    a[: int(n * heavy_share)] = 0.0            # a third of the rows share one value
    b = rng.integers(0, 5, size=n).astype(float)
    c = rng.normal(size=n)
    c[rng.random(n) < null_share] = np.nan      # gaps only in the non-grid column
    rows = [(start + i, float(a[i]), float(b[i]), None if np.isnan(c[i]) else float(c[i])) for i in range(n)]
    arr = np.array([[start + i, a[i], b[i], c[i]] for i in range(n)])
    return spark.createDataFrame(rows, "key bigint, a double, b double, c double"), arr


@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_join_equals_brute_force(spark, exclude_self):
    rng = np.random.default_rng(7)
    dq, aq = _table(spark, rng, 120, start=0)
    dd, ad = (dq, aq) if exclude_self else _table(spark, rng, 400, start=10_000)
    k = 5
    got = knn.knn_join(dq, dd, ["a", "b", "c"], k, exclude_self=exclude_self, cell_target=20).collect()
    want = _brute_knn(aq, ad, k, exclude_self)
    by_q = {}
    for r in got:
        by_q.setdefault(r.q_key, []).append((r.nn_rank, r.d_key, r.dist))
    assert set(by_q) == set(want)
    for qk, lst in by_q.items():
        lst.sort()
        assert [x[1] for x in lst] == [x[1] for x in want[qk]], qk
        assert np.allclose([x[2] for x in lst], [x[0] for x in want[qk]])


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.full(300, 5.0), rng.normal(size=600).round(3)])
    grp = np.array([i % 2 for i in range(len(vals))])
    # the second group is NULL
    df = spark.createDataFrame([(int(g) if g == 0 else None, float(v)) for g, v in zip(grp, vals)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy).collect()
    for r in got:
        want = np.quantile(vals[grp == (1 if r.g is None else 0)], probs[r.q_index])
        assert r.quantile == pytest.approx(want, abs=1e-9)
    assert len(got) == 2 * len(probs)


def test_hash_rank_is_a_dense_permutation(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    r = ranking.hash_rank(df, "g", "key", 42, "t", "rk", u_name="u").toPandas()
    for g, part in r.groupby("g"):
        assert sorted(part.rk) == list(range(len(part)))
        ordered = part.sort_values(["u", "key"])
        assert list(ordered.rk) == list(range(len(part)))


def test_with_row_index_follows_key_order(spark):
    df = spark.range(0, 5000, 7).select(F.col("id").alias("key"))
    r = ranking.with_row_index(df, "key").orderBy("key").toPandas()
    assert list(r.row_index) == list(range(len(r)))


def test_auc_exact_with_ties(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, size=400)
    s = np.round(rng.random(400) * 0.5 + 0.3 * y, 1)  # coarse scores: many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.auc_exact(df, "y", "s").first()["ROC-AUC"]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-12)


def test_auc_is_null_without_both_classes(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert metrics.auc_exact(df, "y", "s").first()["ROC-AUC"] is None


def test_tree_shap_adds_up_to_the_forest_probability(spark):
    df = spark.range(400).select(
        F.col("id").alias("key"), (F.col("id") % 11).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"), ((F.col("id") * 13) % 5).cast("double").alias("c"),
        (((F.col("id") % 11) + (F.col("id") % 7)) > 9).cast("int").alias("y"))
    feats = ["a", "b", "c"]
    model = forest.fit_forest(df, feats, "y", {"n_estimators": 6, "max_depth": 4})
    sh = explain.tree_shap(df, explain.forest_nodes(model), feats, "key").toPandas().set_index("key")
    prob = forest.predict(df, model, feats).select("key", "prob").toPandas().set_index("key")["prob"]
    total = sh.base_value + sh.shap.apply(sum)
    assert np.allclose(total, sh.prediction, atol=1e-9)
    assert np.allclose(sh.prediction.loc[prob.index], prob, atol=1e-9)


def test_ordinal_encoder_sorted_codes_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    enc = encode.fit_ordinal(df, ["s"])
    assert {r.category: r.code for r in enc.table.collect()} == {"a": 0, "b": 1, "c": 2}
    new = spark.createDataFrame([("z",)], "s string")
    with pytest.raises(Exception):
        enc.transform(new).collect()
    assert enc.transform(new, on_unknown="null").first()["s"] is None


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), int(i % 6 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, x double, z double, y int")
    out = smote.smote(df, "y", "key", ["x", "z"], k=3, seed=1)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 250
    syn = out.where("synthetic").toPandas()
    mins = np.array([(x, z) for i, x, z, y in rows if y == 1])
    # every synthetic point lies inside the bounding box of the minority class
    assert (syn.x >= mins[:, 0].min() - 1e-9).all() and (syn.x <= mins[:, 0].max() + 1e-9).all()
    assert syn.key.isna().all() and len(syn) == 200


def test_ordinal_encoder_round_trip(spark):
    df = spark.createDataFrame([(i, f"c{i % 37}", f"d{i % 5}" if i % 7 else None) for i in range(300)],
                               "k int, s string, t string")
    fitted = encode.fit_ordinal(df, ["s", "t"])
    coded = fitted.transform(df)
    order = sorted({f"c{i}" for i in range(37)})
    assert {r.k: r.s for r in coded.collect()} == {i: float(order.index(f"c{i % 37}")) for i in range(300)}
    back = fitted.decode(fitted.decode(coded, "s", "s"), "t", "t")
    assert sorted(tuple(r) for r in back.collect()) == [(i, f"c{i % 37}", f"d{i % 5}" if i % 7 else "nan") for i in range(300)]
    with pytest.raises(Exception):
        fitted.transform(spark.createDataFrame([(1, "zz", "d1")], df.schema)).collect()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_join_with_a_third_identical_queries(spark, exclude_self):
    rng = np.random.default_rng(9)
    n = 150
    rows, arr = [], []
    for i in range(n):
        if i % 3 == 0:   # a third of the rows: one identical vector with a gap
            a, b, c = 0.0, 1.0, None
        else:
            a, b, c = round(float(rng.normal()), 2), float(rng.integers(0, 4)), float(rng.normal())
        rows.append((i, a, b, c))
        arr.append([i, a, b, np.nan if c is None else c])
    df = spark.createDataFrame(rows, "key bigint, a double, b double, c double")
    arr = np.array(arr)
    got = knn.knn_join(df, df, ["a", "b", "c"], 4, exclude_self=exclude_self, cell_target=16).collect()
    want = _brute_knn(arr, arr, 4, exclude_self)
    by_q = {}
    for r in got:
        by_q.setdefault(r.q_key, []).append((r.nn_rank, r.d_key))
    assert set(by_q) == set(want)
    for qk, lst in by_q.items():
        assert [x[1] for x in sorted(lst)] == [x[1] for x in want[qk]], qk


def test_fold_metrics_keep_a_null_group(spark):
    rng = np.random.default_rng(13)
    rows = [(int(rng.random() < 0.4), float(round(rng.random(), 1)), None if i % 3 == 2 else i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "y int, s double, g int").withColumn("p", (F.col("s") > 0.5).cast("int"))
    got = {r.g: r for r in metrics.binary_metrics(df, "y", "p", "s", ["g"]).collect()}
    assert set(got) == {0, 1, None} and all(r["ROC-AUC"] is not None for r in got.values())


def test_auc_exact(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, size=500)
    s = np.round(rng.random(500) * 0.6 + 0.3 * y, 2)
    df = spark.createDataFrame([(int(a), float(b), int(i % 2)) for i, (a, b) in enumerate(zip(y, s))],
                               "y int, s double, g int")
    got = {r.g: r["ROC-AUC"] for r in metrics.auc_exact(df, "y", "s", by="g").collect()}
    for g in (0, 1):
        yy, ss = y[np.arange(500) % 2 == g], s[np.arange(500) % 2 == g]
        pos, neg = ss[yy == 1], ss[yy == 0]
        want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_join_queries_with_gaps_in_grid_columns(spark, exclude_self):
    """Donors complete, queries with gaps in some columns (the imputation case)."""
    rng = np.random.default_rng(21)
    def make(n, start, gaps):
        rows, arr = [], []
        for i in range(n):
            a, b, c = round(float(rng.normal()), 2), float(rng.integers(0, 40)), float(rng.normal())
            if gaps and i % 4 == 1:
                a = None
            if gaps and i % 4 == 2:
                c = None
            rows.append((start + i, a, b, c))
            arr.append([start + i, np.nan if a is None else a, b, np.nan if c is None else c])
        return spark.createDataFrame(rows, "key bigint, a double, b double, c double"), np.array(arr)
    if exclude_self:
        dq, aq = make(200, 0, True)
        dd, ad = dq, aq
    else:
        dq, aq = make(120, 0, True)
        dd, ad = make(500, 10_000, False)
    got = knn.knn_join(dq, dd, ["a", "b", "c"], 5, exclude_self=exclude_self, cell_target=16).collect()
    want = _brute_knn(aq, ad, 5, exclude_self)
    by_q = {}
    for r in got:
        by_q.setdefault(r.q_key, []).append((r.nn_rank, r.d_key))
    assert set(by_q) == set(want)
    for qk, lst in by_q.items():
        assert [x[1] for x in sorted(lst)] == [x[1] for x in want[qk]], qk


def test_knn_join_any_gap_pattern(spark):
    """Every column has gaps on both sides; string keys keep their type."""
    rng = np.random.default_rng(5)
    cols = ["a", "b", "c"]

    def make(n, prefix):
        rows = []
        for i in range(n):
            v = [None if rng.random() < 0.3 else float(rng.normal()) for _ in cols]
            rows.append((f"{prefix}{i:03d}", *v))
        return rows

    qs, ds = make(40, "q"), make(200, "d")
    schema = "key string, a double, b double, c double"
    got = {}
    for r in knn.knn_join(spark.createDataFrame(qs, schema), spark.createDataFrame(ds, schema), cols, 4, cell_target=10).collect():
        got.setdefault(r.q_key, []).append((r.nn_rank, r.d_key))
    for qk, *q in qs:
        far = []
        for dk, *d in ds:
            both = [(x, y) for x, y in zip(q, d) if x is not None and y is not None]
            if both:
                far.append((np.sqrt(3 / len(both) * sum((x - y) ** 2 for x, y in both)), dk))
        far.sort(key=lambda t: (round(t[0], 9), t[1]))
        assert [k for _, k in sorted(got.get(qk, []))] == [k for _, k in far[:4]], qk
    empty = knn.knn_join(spark.createDataFrame(qs, schema).limit(0), spark.createDataFrame(ds, schema), cols, 4)
    assert dict(empty.dtypes)["q_key"] == "string" and empty.count() == 0


def test_knn_join_frees_its_frames(spark):
    spark.catalog.clearCache()
    df = spark.range(200).selectExpr("id AS key", "cast(id % 17 AS double) AS a", "cast(id % 5 AS double) AS b")
    impute.knn_impute(df.withColumn("a", F.when(F.col("key") % 9 > 0, F.col("a"))), ["a", "b"], "key", 3).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_smote_names_missing_values(spark):
    rows = [(i, float(i), 0 if i < 20 else 1) for i in range(30)]
    schema = "key bigint, x double, y int"
    with pytest.raises(ValueError, match="'x'"):
        smote.smote(spark.createDataFrame(rows + [(99, None, 1)], schema), "y", "key", ["x"], 3)
    with pytest.raises(ValueError, match="'y'"):
        smote.smote(spark.createDataFrame(rows + [(99, 1.0, None)], schema), "y", "key", ["x"], 3)


def test_numbers_print_like_c(spark):
    from tabrisk.functions.text import fixed1, signed4
    values = [0.25, 0.75, 0.15, 0.35, 0.05, -0.25, 2.5, 1e10 + 0.25, 0.0, -0.0, 0.99, 9.95, 1.45, 123456.65, 0.00005, -0.00015, 0.12345]
    rng = np.random.default_rng(8)
    values += [float(v) for v in np.round(rng.normal(size=300) * 100, 2)] + [float(v) for v in rng.normal(size=100)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed1("x").alias("f"), signed4("x").alias("s"))
    for r in df.collect():
        assert r.f == f"{r.x:.1f}" and r.s == f"{r.x:+.4f}", r


def test_min_samples_split_is_not_ignored():
    from tabrisk.operators.forest import forest_params, split_bound
    assert forest_params({"min_samples_split": 4, "min_samples_leaf": 2}, 4) == {"minInstancesPerNode": 2}
    assert [split_bound({"min_samples_split": s, "min_samples_leaf": m}) for s, m in ((5, 1), (5, 2), (4, 2), (2, 1))] == [5, 5, 2, 2]


def test_checkpoint_folder_of_the_caller_stays(spark):
    from tabrisk.session import checkpoint_dir, cut_lineage
    before = spark.sparkContext.getCheckpointDir()
    cut_lineage(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() == before == checkpoint_dir(spark)


def test_tree_shap_closed_form_on_a_depth_two_tree(spark):
    """A hand-set tree: x <= 0 ? 1 : (y <= 0 ? 2 : 6), covers 4 / 4 split 2 / 2."""
    rows = [(0, 0, 1, 2, 0, 0.0, [], -1, 0.0, 8.0), (0, 1, -1, -1, -1, None, [], -1, 1.0, 4.0),
            (0, 2, 3, 4, 1, 0.0, [], -1, 0.0, 4.0), (0, 3, -1, -1, -1, None, [], -1, 2.0, 2.0),
            (0, 4, -1, -1, -1, None, [], -1, 6.0, 2.0)]
    nodes = spark.createDataFrame(rows, explain.NODE_SCHEMA)
    df = spark.createDataFrame([(1, -1.0, -1.0), (2, 1.0, -1.0), (3, 1.0, 1.0), (4, -1.0, 1.0)], "key int, x double, y double")
    got = {r.key: r for r in explain.tree_shap(df, nodes, ["x", "y"], "key").collect()}
    f = {1: (1, 1, 3), 2: (2, 4, 1.5), 3: (6, 4, 3.5), 4: (1, 1, 3.5)}  # f(x, y), E[f | x], E[f | y]
    f[1] = (1, 1, 1.5)  # y <= 0: (1 + 2) / 2; y > 0: (1 + 6) / 2
    mean = 2.5
    for key, (both, x, y) in f.items():
        assert got[key].base_value == pytest.approx(mean)
        assert got[key].shap[0] == pytest.approx(((x - mean) + (both - y)) / 2)
        assert got[key].shap[1] == pytest.approx(((y - mean) + (both - x)) / 2)
        assert got[key].prediction == pytest.approx(both)


def test_smote_rows_lie_between_two_rows_of_their_class(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), int(i < 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "key bigint, a double, b double, y int")
    out = smote.smote(df, "y", "key", ["a", "b"], 4).where("synthetic").collect()
    own = np.array([(a, b) for _, a, b, y in rows if y == 1])
    assert len(out) == 36
    for r in out:
        p = np.array([r.a, r.b])
        d = own[None, :, :] - own[:, None, :]
        cross = d[..., 0] * (p[1] - own[:, None, 1]) - d[..., 1] * (p[0] - own[:, None, 0])
        t = ((p - own[:, None, :]) * d).sum(-1) / np.maximum((d ** 2).sum(-1), 1e-300)
        assert ((abs(cross) < 1e-9) & (t >= -1e-9) & (t <= 1 + 1e-9)).any()


def test_planted_signal_is_found(spark):
    df = spark.range(600).selectExpr("id AS key", "cast(id % 37 AS double) AS noise", "cast((id * 7919) % 101 AS double) AS signal")
    df = df.withColumn("y", (F.col("signal") > 92).cast("int"))
    df = metrics.with_folds(df, "y", "key", 3)
    model = forest.fit_forest(df.where("fold > 0"), ["noise", "signal"], "y", {"n_estimators": 10, "max_depth": 4})
    auc = metrics.auc_exact(forest.predict(df.where("fold = 0"), model, ["noise", "signal"]), "y", "prob").first()[0]
    assert auc > 0.9
    assert forest.feature_importance(spark, model, ["noise", "signal"]).first()["feature"] == "signal"


def test_unshuffled_folds_follow_the_key(spark):
    df = spark.range(50).selectExpr("id AS key", "cast(id % 2 AS int) AS y").repartition(7)
    got = {r.key: r.fold for r in metrics.with_folds(df, "y", "key", 5, shuffle=False).collect()}
    assert got == {k: (k // 2) % 5 for k in range(50)}


def test_clinical_micro_table(spark):
    """Twelve hand-made records: valid categories, missing values, codes and labels, shown values."""
    from tabrisk.functions import dictionaries as D
    from tabrisk.functions.text import format_value
    from tabrisk.operators import clean
    genders = ["Male", "Female", "Other", " Other ", "", None, "Male", "Female", "Male", "Female", "Female", "Male"]
    rows = [(i, g, 20.5 + i, 100.25 + i, None if i in (6, 9) else 22.25 + i) for i, g in enumerate(genders)]
    df = spark.createDataFrame(rows, "id bigint, gender string, age double, avg_glucose_level double, bmi double")
    kept = clean.filter_valid_category(df, "gender", "Other")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11]  # ' Other ' is not 'Other'
    fitted = encode.fit_ordinal(kept, ["gender"])
    assert {r.category: r.code for r in fitted.table.collect()} == {" Other ": 0, "Female": 1, "Male": 2}
    full = impute.knn_impute(kept, ["age", "avg_glucose_level", "bmi"], "id", 2)
    assert full.where(F.col("bmi").isNull()).count() == 0
    long = spark.createDataFrame([("bmi", 22.25), ("bmi", None), ("nothing", 9.0)], "feature string, value double")
    shown = [r[0] for r in long.select(format_value("feature", "value", D.CLINICAL_VALUE_LABELS, D.CLINICAL_RULES)).collect()]
    assert shown[0].startswith("22.2") and shown[1] is None and shown[2] == "9.0"


@pytest.mark.parametrize("kind", ["ties", "normal", "wide"])
def test_quantiles_in_rounds(spark, kind):
    """A tiny limit: many rounds, heavy ties, NULL groups."""
    rng = np.random.default_rng(17)
    v = {"ties": rng.integers(0, 4, 3000).astype(float), "normal": rng.normal(size=3000),
         "wide": rng.normal(size=3000) ** 7 * 1e6}[kind]
    rows = [(None if i % 5 == 0 else i % 3, float(x)) for i, x in enumerate(v)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {(r.g, r.q_index): r.quantile for r in quantiles.exact_quantiles(df, "v", probs, ["g"], accuracy=200, limit=5).collect()}
    assert len(got) == 4 * len(probs)
    for g in (None, 0, 1, 2):
        own = [x for k, x in rows if k == g and x is not None]
        for i, p in enumerate(probs):
            assert got[g, i] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)


def test_prefix_sums_in_many_buckets(spark):
    """A hot group of ten times the rows of the others: no bucket is much above its size."""
    from tabrisk.operators import ranking
    rows = [(None if i % 11 == 0 else "hot" if i % 11 < 9 else f"g{i % 7}", (i * 7919) % 20011, float(i % 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k bigint, w double")
    got = ranking.prefix_sums(df, ["g"], ["k"], {"before": F.col("w"), "n": F.lit(1)}, rows_per_bucket=100)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.g), r.k)):
        n, w = seen.get(r.g, (0, 0.0))
        assert (r.n, r.before) == (n, w)
        seen[r.g] = n + 1, w + r.w
    assert sum(n for n, _ in seen.values()) == 4000
    dealt = df.repartitionByRange(40, "g", "k").groupBy(F.spark_partition_id().alias("b")).count().collect()
    assert max(r["count"] for r in dealt) <= 250 and len(dealt) >= 30


def test_auc_of_one_fold_in_many_buckets(spark):
    rng = np.random.default_rng(31)
    y, s = rng.integers(0, 2, size=1500), np.round(rng.random(1500), 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.auc_exact(df, "y", "s", rows_per_bucket=50).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-12)


def test_codes_of_many_categories_are_dealt(spark):
    df = spark.range(3000).selectExpr("concat('c', lpad(cast(id * 37 % 3000 as string), 4, '0')) AS s", "cast(id % 3 as string) AS t")
    enc = encode.fit_ordinal(df, ["s", "t"], rows_per_bucket=100)
    got = {(r.feature, r.category): r.code for r in enc.table.collect()}
    assert got == {**{("s", f"c{i:04d}"): i for i in range(3000)}, **{("t", str(i)): i for i in range(3)}}


def test_first_and_last_rows(spark):
    from tabrisk.operators import ranking
    df = spark.range(100).selectExpr("(id * 37) % 100 AS key", "cast((id * 37) % 100 % 3 AS int) AS g").repartition(5)
    assert [r.key for r in ranking.head(df, "key", 4).orderBy("key").collect()] == [0, 1, 2, 3]
    assert sorted((r.g, r.key) for r in ranking.first_n(df, "key", 2, "g").collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert ranking.last_row(df, "key").first().key == 99
    assert sorted((r.g, r.key) for r in ranking.last_row(df, "key", ["g"]).collect()) == [(0, 99), (1, 97), (2, 98)]
    ranked = ranking.bottom_k(df, [F.col("key").desc()], 3, name="n").orderBy("n").collect()
    assert [(r.n, r.key) for r in ranked] == [(1, 99), (2, 98), (3, 97)]
    plan = ranking.first_n(df, "key", 2, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
