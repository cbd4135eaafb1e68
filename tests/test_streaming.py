"""Fitted preparation on Structured Streaming sources: per-row transforms on a
file stream, and per-micro-batch full preparation appended as batch
directories numbered by micro-batch id."""

from pyspark.sql import functions as F

from tabrisk.plans.prepare import PrepSpec, prepare
from tabrisk.sources import io
from tabrisk.sources.fixtures import SUBJECT_FEATURES, subjects
from tabrisk.streaming.apply import encode_and_scale_stream, prepare_stream

SPEC = PrepSpec(key="key", label="label", categorical=["segment", "top_priority"],
                scaled=["n_orders", "avg_price", "max_price"], impute_target="max_price",
                feature_order=SUBJECT_FEATURES)


def _fit(spark, sf_dir):
    s = subjects(spark, sf_dir)
    fitted, scaled, display = prepare(s.where(F.col("key") % 5 != 0), SPEC)
    return s, fitted


def test_encode_and_scale_stream_matches_batch(spark, sf_dir, tmp_path):
    s, fitted = _fit(spark, sf_dir)
    new = s.where(F.col("key") % 5 == 0).where(F.col("max_price").isNotNull())
    src = str(tmp_path / "in")
    new.write.parquet(src)
    stream = spark.readStream.schema(new.schema).parquet(src)
    q = (encode_and_scale_stream(fitted, stream).writeStream.format("memory").queryName("scaled_stream")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("scaled_stream")
    want, _ = fitted.apply(new)
    cols = ["key", "segment", "n_orders", "avg_price", "max_price"]
    a = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.select(cols).collect())
    b = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want.select(cols).collect())
    assert a == b and len(a) > 0


def test_prepare_stream_appends_each_micro_batch_once(spark, sf_dir, tmp_path):
    s, fitted = _fit(spark, sf_dir)
    new = s.where(F.col("key") % 5 == 0)
    src = str(tmp_path / "in")
    for i in range(5):
        new.where(F.col("key") % 25 == 5 * i).coalesce(1).write.parquet(f"{src}/{i}")
    spark.catalog.clearCache()
    stream = (spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    scaled_path, display_path = str(tmp_path / "scaled"), str(tmp_path / "display")
    q = prepare_stream(fitted, stream, scaled_path, display_path, str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None
    cur = io.read_current(spark, display_path)
    assert cur.count() == new.count()
    assert cur.where(F.col("max_price").isNull()).count() == 0
    # five micro-batches leave no persisted frame behind
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    # a stream that starts again elsewhere adds batches and overwrites none
    again = prepare_stream(fitted, stream, scaled_path, display_path, str(tmp_path / "other"))
    again.awaitTermination(300)
    assert io.read_current(spark, display_path).count() == 2 * new.count()
    assert io.committed_batches(spark, scaled_path) == io.committed_batches(spark, display_path)
