"""Stand-in tables built from the driver's parquet data.

``subjects`` plays the part of the clinical record table: one row per
customer, categorical, binary, numeric and a rare binary label, with missing
values injected deterministically (md5 of the key, not a filter: every row is
kept).

It has a DuckDB SQL twin, ``SUBJECTS_SQL``, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.functions.rnd import sql_uniform, uniform

# Fixed values of the fixture.
SEED = 42
MISSING_RATE = 0.04          # share of max_price set to NULL
MANY_ORDERS_ABOVE = 10       # many_orders = count(orders) > 10

SUBJECT_CATEGORICAL = ["segment", "top_priority"]
SUBJECT_NUMERIC = ["n_orders", "avg_price", "max_price"]
SUBJECT_BINARY = ["many_orders"]
SUBJECT_FEATURES = ["segment", "top_priority", "many_orders", "n_orders", "avg_price", "max_price"]
SUBJECT_COLUMNS = ["key"] + SUBJECT_FEATURES + ["label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer.

    Aggregates orders per customer first (partial aggregation before the
    shuffle on o_custkey), then joins the customer table on the same key.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    per_cust = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("o_totalprice").alias("avg_p"),
        F.max("o_totalprice").alias("max_p"),
        # highest-priced order, ties to the smaller order key
        F.max_by("o_orderpriority",
                 F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("top_priority"),
    )
    joined = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    missing = uniform(SEED, "missing", F.col("c_custkey")) < MISSING_RATE
    return joined.select(
        F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("segment"),
        F.col("top_priority"),
        (n > MANY_ORDERS_ABOVE).cast("int").alias("many_orders"),
        n.cast("double").alias("n_orders"),
        F.round(F.col("avg_p"), 6).alias("avg_price"),
        F.when(missing, F.lit(None).cast("double")).otherwise(F.col("max_p")).alias("max_price"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
    )


SUBJECTS_SQL = f"""
subjects AS (
  SELECT c.c_custkey AS key,
         c.c_mktsegment AS segment,
         a.top_priority,
         CAST(coalesce(a.n, 0) > {MANY_ORDERS_ABOVE} AS INTEGER) AS many_orders,
         CAST(coalesce(a.n, 0) AS DOUBLE) AS n_orders,
         round(a.avg_p, 6) AS avg_price,
         CASE WHEN {sql_uniform(SEED, 'missing', 'c.c_custkey')} < {MISSING_RATE}
              THEN NULL ELSE a.max_p END AS max_price,
         CAST(c.c_acctbal < 0 AS INTEGER) AS label
  FROM customer c
  LEFT JOIN (
    SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS avg_p, max(o_totalprice) AS max_p,
           arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS top_priority
    FROM orders GROUP BY o_custkey) a
  ON c.c_custkey = a.o_custkey
)"""


def with_views(*views: str) -> str:
    """``WITH`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(views) + "\n"
