"""Physical-plan properties the design relies on: scans read only the needed
columns, filters reach the scan, per-group top-k is planned as a group limit
before the shuffle."""

from pyspark.sql import functions as F

from tabrisk.operators import knn
from tabrisk.plans.catalog import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark, sf_dir):
    plan = _plan(QUERIES["filter_valid_category"](spark, sf_dir))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans
    for line in scans:
        if "customer.parquet" in line:
            assert "c_name" not in line and "c_nationkey" not in line
            assert "IsNotNull(c_mktsegment)" in line


def test_knn_top_k_is_a_pre_shuffle_group_limit(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"))
    from tabrisk.session import Held
    q = df.select(F.col("key").alias("_qk"), F.col("a").alias("q_a"), F.col("b").alias("q_b"))
    d = df.select(F.col("key").alias("_dk"), F.col("a").alias("d_a"), F.col("b").alias("d_b"))
    held = Held()
    out = knn._search(q, d, ["a", "b"], 4, 2, 64, held)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    held.release()
    assert "WindowGroupLimit" in plan


def test_knn_plans_follow_the_levels(spark, monkeypatch):
    """A deeper tree of cells has a plan longer by a scan a level, not one that doubles."""
    from tabrisk.session import Held
    monkeypatch.setattr(knn, "FAN_OUT", 2)
    monkeypatch.setattr(knn, "_CUTS", [0.5])

    def length(n):
        df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 7 % 1009).cast("double").alias("a"))
        held = Held()
        out = knn._search(df.select(F.col("key").alias("_qk"), F.col("a").alias("q_a")).where("_qk < 9"),
                          df.select(F.col("key").alias("_dk"), F.col("a").alias("d_a")), ["a"], 2, 1, 4, held)
        text = out._jdf.queryExecution().executedPlan().toString()
        held.release()
        return len(text)

    small, large = length(8), length(32)
    assert large < 2.5 * small


def test_knn_frees_its_scratch_tables(spark):
    import os

    from tabrisk.session import checkpoint_dir
    kept = lambda: {x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("held-")}
    before = kept()
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 97).cast("double").alias("a"))
    out = knn.knn_join(df, df, ["a"], 2, cell_target=8)
    assert kept() == before
    assert out.count() == 600


def test_registered_grid_has_distinct_candidates(monkeypatch):
    """No two candidates of the registered search map to the same forest."""
    import json

    from tabrisk.plans import catalog

    seen = []
    monkeypatch.setattr(catalog, "_prepared_with_folds", lambda spark, sf: None)
    monkeypatch.setattr(catalog.forest, "grid_search", lambda *a, **k: (seen.append(a[4]), None))
    catalog.q_grid_search(None, None)
    candidates = catalog.forest.expand_grid(seen[0])
    mapped = {json.dumps(catalog.forest.forest_params(c, len(catalog.FEATURES)), sort_keys=True) for c in candidates}
    assert len(mapped) == len(candidates) > 2
