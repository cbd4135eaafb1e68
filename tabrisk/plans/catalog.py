"""Registered queries and their DuckDB oracles.

Every entry reads the driver's tables (through the fixture views) and runs an
operator of this package over the whole table.  ``ORACLES`` holds, for each
name that has one, SQL over the same parquet views that must return the same
rows; doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.operators import profile
from tabrisk.session import cut_lineage
from tabrisk.sources import io
from tabrisk.sources.fixtures import (SUBJECT_CATEGORICAL, SUBJECT_COLUMNS, SUBJECT_NUMERIC,
                                      SUBJECTS_SQL, subjects, with_views)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


SUBJ = with_views(SUBJECTS_SQL)

# ---------------------------------------------------------------- profiling


@register("row_count", SUBJ + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_positive,
       count(*) FILTER (WHERE max_price IS NULL) AS n_missing_max_price,
       8 AS n_columns
FROM subjects""")
def q_row_count(spark, sf):
    s = subjects(spark, sf)
    return profile.row_count(s, {"n_positive": F.col("label") == 1,
                                 "n_missing_max_price": F.col("max_price").isNull()}).select(
        "n_rows", "n_positive", "n_missing_max_price", "n_columns")


@register("distinct_values", SUBJ + "SELECT DISTINCT top_priority AS value FROM subjects")
def q_distinct_values(spark, sf):
    return profile.distinct_values(subjects(spark, sf), "top_priority")


@register("value_counts", SUBJ + """
SELECT segment AS value, count(*) AS count FROM subjects
WHERE segment IS NOT NULL GROUP BY segment""")
def q_value_counts(spark, sf):
    return profile.value_counts(subjects(spark, sf), "segment")


@register("value_proportions", SUBJ + """
SELECT CAST(label AS INTEGER) AS value, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (), 6) AS proportion
FROM subjects WHERE label IS NOT NULL GROUP BY label""")
def q_value_proportions(spark, sf):
    vc = profile.value_counts(subjects(spark, sf), "label", normalize=True)
    return vc.select("value", "count", r6("proportion").alias("proportion"))


@register("profile_categorical", SUBJ + """
SELECT feature, value, count(*) AS count FROM (
  SELECT 'segment' AS feature, segment AS value FROM subjects
  UNION ALL SELECT 'top_priority', top_priority FROM subjects
  UNION ALL SELECT 'many_orders', CAST(many_orders AS VARCHAR) FROM subjects
  UNION ALL SELECT 'label', CAST(label AS VARCHAR) FROM subjects)
WHERE value IS NOT NULL GROUP BY feature, value""")
def q_profile_categorical(spark, sf):
    return profile.profile_categorical(
        subjects(spark, sf), SUBJECT_CATEGORICAL + ["many_orders", "label"])


@register("missing_counts", SUBJ + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM subjects"
    for c in SUBJECT_COLUMNS) + ")")
def q_missing_counts(spark, sf):
    return profile.missing_counts(subjects(spark, sf))


# DuckDB type names as Spark prints them (fixed values of the two engines)
_DUCK_TO_SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                       "BOOLEAN": "boolean", "SMALLINT": "smallint", "FLOAT": "float"}


@register("column_info", SUBJ + f"""
, types AS (SELECT column_name AS "column", column_type FROM (DESCRIBE SELECT * FROM subjects)),
miss AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM subjects"
                             for c in SUBJECT_COLUMNS)})
SELECT CAST(list_position({"[" + ", ".join(f"'{c}'" for c in SUBJECT_COLUMNS) + "]"}, t."column") - 1 AS INTEGER) AS pos,
       t."column", CASE t.column_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DUCK_TO_SPARK_TYPE.items())}
       ELSE lower(t.column_type) END AS type, m.n_missing
FROM types t JOIN miss m ON t."column" = m.col""")
def q_column_info(spark, sf):
    """Column types with missing counts (what a dtypes + isnull().sum() report shows)."""
    s = subjects(spark, sf)
    return (profile.column_types(spark, s)
            .join(profile.missing_counts(s), "column")
            .select("pos", "column", "type", "n_missing"))


@register("describe_numeric", SUBJ + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM subjects""" for c in SUBJECT_NUMERIC + ["many_orders", "key"]))
def q_describe_numeric(spark, sf):
    d = profile.describe(subjects(spark, sf), SUBJECT_NUMERIC + ["many_orders", "key"])
    return d.select("feature", "count", *[r6(c).alias(c) for c in
                                          ["mean", "std", "min", "p25", "p50", "p75", "max"]])


CORR_CANDIDATES = ["key", "many_orders", "n_orders", "avg_price", "label"]


def _sql_corr(x: str, t: str) -> str:
    both = f"({x} IS NOT NULL AND {t} IS NOT NULL)"
    xm, tm = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({t} AS DOUBLE) END"
    den = f"(stddev_pop({xm}) * stddev_pop({tm}))"
    return f"CASE WHEN {den} > 0 THEN covar_pop({xm}, {tm}) / {den} END"


@register("corr_with_target", SUBJ + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round({_sql_corr(c, 'max_price')}, 6) AS corr,
       round(abs({_sql_corr(c, 'max_price')}), 6) AS abs_corr, {i + 1} AS pos
FROM subjects""" for i, c in enumerate(CORR_CANDIDATES)))
def q_corr_with_target(spark, sf):
    c = profile.corr_with(subjects(spark, sf), "max_price", CORR_CANDIDATES)
    return c.select("feature", r6("corr").alias("corr"), r6("abs_corr").alias("abs_corr"), "pos")


# ------------------------------------------------- filters, keys, reshaping

from tabrisk.functions.rnd import sql_uniform  # noqa: E402
from tabrisk.functions.text import map_lookup  # noqa: E402
from tabrisk.operators import clean, encode, qcut, reshape, scale  # noqa: E402
from tabrisk.operators import select as fselect  # noqa: E402
from tabrisk.operators.ranking import hash_rank, with_row_index  # noqa: E402


@register("filter_valid_category", SUBJ + r"""
SELECT key, segment FROM subjects
WHERE segment IS NOT NULL AND regexp_replace(segment, '^\s+|\s+$', '', 'g') <> ''
  AND lower(segment) <> 'machinery'""")
def q_filter_valid_category(spark, sf):
    return clean.filter_valid_category(subjects(spark, sf), "segment", reject="machinery").select(
        "key", "segment")


@register("with_row_index", SUBJ + """
SELECT key, row_number() OVER (ORDER BY key) - 1 AS row_index FROM subjects""")
def q_with_row_index(spark, sf):
    return with_row_index(subjects(spark, sf), "key", "row_index").select("key", "row_index")


def _positive_key_list(spark, sf):
    """Key list with positions: positive subjects in a seeded random order."""
    pos = subjects(spark, sf).where(F.col("label") == 1).select("key")
    return hash_rank(pos, None, "key", 42, "pick", "pos")


POSITIVE_KEY_LIST_SQL = f"""
key_list AS (
  SELECT key, row_number() OVER (ORDER BY {sql_uniform(42, 'pick', 'key')}, key) - 1 AS pos
  FROM subjects WHERE label = 1
)"""


@register("take_keys", with_views(SUBJECTS_SQL, POSITIVE_KEY_LIST_SQL) + """
SELECT s.key, k.pos, s.segment, s.avg_price FROM subjects s JOIN key_list k ON s.key = k.key""")
def q_take_keys(spark, sf):
    return clean.take_keys(subjects(spark, sf), _positive_key_list(spark, sf), "key").select(
        "key", "pos", "segment", "avg_price")


@register("lookup_keys", SUBJ + """
, req AS (SELECT key FROM subjects WHERE label = 1 UNION ALL SELECT -key FROM subjects WHERE label = 1)
SELECT r.key, s.key IS NOT NULL AS found FROM req r LEFT JOIN subjects s ON r.key = s.key""")
def q_lookup_keys(spark, sf):
    """Bounds-checked point lookup: every requested key with whether a row exists
    (requests: the positive keys and their negatives, which never exist)."""
    s = subjects(spark, sf)
    pos = s.where(F.col("label") == 1)
    req = pos.select("key").unionByName(pos.select((-F.col("key")).alias("key")))
    found, missing = clean.lookup_keys(s, req, "key")
    return (found.select("key", F.lit(True).alias("found"))
            .unionByName(missing.select("key", F.lit(False).alias("found"))))


@register("exclude_keys", SUBJ + """
SELECT key, segment, label FROM subjects
WHERE key NOT IN (SELECT key FROM subjects WHERE top_priority = '1-URGENT')""")
def q_exclude_keys(spark, sf):
    s = subjects(spark, sf)
    urgent = s.where(F.col("top_priority") == "1-URGENT").select("key")
    return clean.exclude_keys(s, urgent, "key").select("key", "segment", "label")


def _scaled_numeric(s):
    z = scale.fit_zscore(s, SUBJECT_NUMERIC)
    return z, z.transform(s)


def _sql_z(c):
    return f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)"


@register("align_twins", SUBJ + f"""
SELECT key, {", ".join(f"round({_sql_z(c)}, 6) AS {c}" for c in SUBJECT_NUMERIC)},
       {", ".join(f"{c} AS {c}_original" for c in SUBJECT_NUMERIC)}, label
FROM subjects""")
def q_align_twins(spark, sf):
    s = subjects(spark, sf).select("key", *SUBJECT_NUMERIC, "label")
    _, scaled = _scaled_numeric(s)
    scaled = scaled.select("key", *[r6(c).alias(c) for c in SUBJECT_NUMERIC], "label")
    return clean.align(scaled, s.select("key", *SUBJECT_NUMERIC), "key")


# Display labels of the encoded market segment used by the
# ``map_labels`` query (code 4 deliberately unmapped to exercise the fallback).
SEGMENT_LABELS = {0: "Automobile", 1: "Building", 2: "Furniture", 3: "Household"}


def _sql_codes(col):
    return (f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({col} AS VARCHAR), 'nan')) - 1 AS DOUBLE)")


def _sql_map(expr, mapping):
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"coalesce(CASE CAST(trunc({expr}) AS INTEGER) {whens} END, CAST({expr} AS VARCHAR))"


@register("map_labels", SUBJ + f"""
SELECT key, code, {_sql_map('code', SEGMENT_LABELS)} AS segment_label
FROM (SELECT key, {_sql_codes('segment')} AS code FROM subjects)""")
def q_map_labels(spark, sf):
    s = subjects(spark, sf)
    enc = encode.fit_ordinal(s, ["segment"])
    coded = enc.transform(s).select("key", F.col("segment").alias("code"))
    return coded.withColumn("segment_label", map_lookup("code", SEGMENT_LABELS))


@register("to_long", SUBJ + " UNION ALL ".join(
    f"SELECT key, '{c}' AS feature, {i} AS feature_pos, CAST({c} AS DOUBLE) AS value FROM subjects"
    for i, c in enumerate(["many_orders"] + SUBJECT_NUMERIC)))
def q_to_long(spark, sf):
    return reshape.to_long(subjects(spark, sf), "key", ["many_orders"] + SUBJECT_NUMERIC).select(
        "key", "feature", "feature_pos", "value")


@register("append_rows", SUBJ + """
SELECT key, segment, n_orders, avg_price, CAST(label AS DOUBLE) AS label FROM subjects WHERE label = 1
UNION ALL
SELECT key, segment, n_orders, NULL AS avg_price, CAST(NULL AS DOUBLE) AS label FROM subjects
WHERE many_orders = 1 AND key NOT IN (SELECT key FROM subjects WHERE label = 1)""")
def q_append_rows(spark, sf):
    s = subjects(spark, sf)
    base = s.where(F.col("label") == 1).select("key", "segment", "n_orders", "avg_price",
                                               F.col("label").cast("double").alias("label"))
    new = s.where(F.col("many_orders") == 1).select("key", "segment", "n_orders")
    return reshape.append_rows(base, new, dedup_key="key")


# ------------------------------------------------ encode, select, scale, bin

ENCODE_SQL = f"""
encoded AS (
  SELECT key, {_sql_codes('segment')} AS segment, {_sql_codes('top_priority')} AS top_priority,
         many_orders, n_orders, avg_price, max_price, label
  FROM subjects
)"""


@register("ordinal_codes", SUBJ + """
SELECT feature, category, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'segment' AS feature, coalesce(segment, 'nan') AS category FROM subjects
      UNION SELECT DISTINCT 'top_priority', coalesce(top_priority, 'nan') FROM subjects)""")
def q_ordinal_codes(spark, sf):
    return encode.fit_ordinal(subjects(spark, sf), SUBJECT_CATEGORICAL).table


@register("ordinal_encode", with_views(SUBJECTS_SQL, ENCODE_SQL) + """
SELECT key, segment, top_priority FROM encoded""")
def q_ordinal_encode(spark, sf):
    s = subjects(spark, sf)
    return encode.fit_ordinal(s, SUBJECT_CATEGORICAL).transform(s).select(
        "key", "segment", "top_priority")


ALL_NUMERIC = ["key", "segment", "top_priority", "many_orders", "n_orders", "avg_price",
               "max_price", "label"]


@register("select_by_corr", with_views(SUBJECTS_SQL, ENCODE_SQL) + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, {i + 1} AS pos, round(abs({_sql_corr(c, 'max_price')}), 6) AS abs_corr,
       coalesce(abs({_sql_corr(c, 'max_price')}) > 0.2, false) OR '{c}' = 'max_price' AS selected
FROM encoded""" for i, c in enumerate(ALL_NUMERIC)))
def q_select_by_corr(spark, sf):
    s = subjects(spark, sf)
    enc = encode.fit_ordinal(s, SUBJECT_CATEGORICAL).transform(s)
    chosen, table = fselect.select_by_corr(enc, "max_price", ALL_NUMERIC, 0.2)
    return table.select("feature", "pos", r6("abs_corr").alias("abs_corr"),
                        F.col("feature").isin(chosen).alias("selected"))


@register("zscore", SUBJ + f"""
SELECT key, {", ".join(f"round({_sql_z(c)}, 6) AS {c}" for c in SUBJECT_NUMERIC)} FROM subjects""")
def q_zscore(spark, sf):
    s = subjects(spark, sf).select("key", *SUBJECT_NUMERIC)
    _, z = _scaled_numeric(s)
    return z.select("key", *[r6(c).alias(c) for c in SUBJECT_NUMERIC])


@register("zscore_inverse", SUBJ + f"""
SELECT key, {", ".join(f"round({c}, 6) AS {c}" for c in SUBJECT_NUMERIC)} FROM subjects""")
def q_zscore_inverse(spark, sf):
    s = subjects(spark, sf).select("key", *SUBJECT_NUMERIC)
    z, scaled = _scaled_numeric(s)
    return z.inverse(scaled).select("key", *[r6(c).alias(c) for c in SUBJECT_NUMERIC])


QCUT_SPEC = [("n_orders", 5), ("avg_price", 3), ("max_price", 3)]


def _sql_qcut(col, q, by):
    probs = ", ".join(repr(p) for p in qcut.qcut_probs(q))
    edges = f"(SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) FROM subjects i WHERE i.{by} = o.{by})"
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE "
            f"CAST(greatest(0, len(list_filter({edges}, lambda e: e < {col})) - 1) AS DOUBLE) END")


@register("qcut_bins", SUBJ + f"""
SELECT key, label, {", ".join(f"{_sql_qcut(c, q, 'label')} AS {c}_bin" for c, q in QCUT_SPEC)}
FROM subjects o""")
def q_qcut_bins(spark, sf):
    out = qcut.qcut_many(subjects(spark, sf), QCUT_SPEC, ["label"])
    # bin codes with missing values are reported as double (NaN), on both sides
    return out.select("key", "label", *[F.col(f"{c}_bin").cast("double").alias(f"{c}_bin") for c, _ in QCUT_SPEC])


# ------------------------------------------------------- kNN and imputation

from tabrisk.operators import impute, knn  # noqa: E402

IMPUTE_COLS = ["n_orders", "avg_price", "max_price"]


def _sql_dist(cols, qa="q", da="d", weights=None):
    """Brute-force NaN-aware distance in SQL; ``weights`` = SQL 0/1 column selectors."""
    terms, pres = [], []
    for c in cols:
        w = f"{weights}.{c} * " if weights else ""
        p = f"CAST({qa}.{c} IS NOT NULL AND {da}.{c} IS NOT NULL AS INTEGER)"
        terms.append(f"{w}CASE WHEN {p} = 1 THEN ({qa}.{c} - {da}.{c}) * ({qa}.{c} - {da}.{c}) ELSE 0.0 END")
        pres.append(f"{w}{p}")
    n = f"CAST({' + '.join(f'{weights}.{c}' for c in cols)} AS DOUBLE)" if weights else f"CAST({len(cols)} AS DOUBLE)"
    m = "(" + " + ".join(pres) + ")"
    return f"CASE WHEN {m} > 0 THEN sqrt({n} / {m} * ({' + '.join(terms)})) END"


def _sql_knn(q_sql, d_sql, cols, k, weights_cte=None):
    wjoin = f", {weights_cte} w" if weights_cte else ""
    return f"""
SELECT q_key, d_key, dist, nn_rank FROM (
  SELECT q_key, d_key, dist, row_number() OVER (PARTITION BY q_key ORDER BY dist, d_key) - 1 AS nn_rank
  FROM (SELECT q.key AS q_key, d.key AS d_key, {_sql_dist(cols, weights='w' if weights_cte else None)} AS dist
        FROM ({q_sql}) q, ({d_sql}) d{wjoin})
  WHERE dist IS NOT NULL)
WHERE nn_rank < {k}"""


def _sql_impute_value(nn_sql, d_sql, target):
    return f"""
SELECT nn.q_key AS key,
       CASE WHEN count(*) FILTER (WHERE nn.dist = 0) > 0
            THEN avg(d.{target}) FILTER (WHERE nn.dist = 0)
            ELSE sum(d.{target} / nn.dist) FILTER (WHERE nn.dist > 0)
                 / sum(CAST(1 AS DOUBLE) / nn.dist) FILTER (WHERE nn.dist > 0) END AS imp
FROM ({nn_sql}) nn JOIN ({d_sql}) d ON nn.d_key = d.key
GROUP BY nn.q_key"""


_Q_MISSING = "SELECT key, n_orders, avg_price, max_price FROM subjects WHERE max_price IS NULL"
_D_PRESENT = "SELECT key, n_orders, avg_price, max_price FROM subjects WHERE max_price IS NOT NULL"


@register("knn_join", SUBJ + f"""
SELECT q_key, d_key, round(dist, 6) AS dist, CAST(nn_rank AS INTEGER) AS nn_rank FROM (
{_sql_knn(_Q_MISSING, _D_PRESENT, IMPUTE_COLS, 5)})""")
def q_knn_join(spark, sf):
    s = subjects(spark, sf)
    qs = s.where(F.col("max_price").isNull())
    ds = s.where(F.col("max_price").isNotNull())
    nn = knn.knn_join(qs, ds, IMPUTE_COLS, 5)
    return nn.select("q_key", "d_key", r6("dist").alias("dist"), "nn_rank")


@register("knn_impute", SUBJ + f"""
SELECT s.key, s.n_orders, s.avg_price,
       round(coalesce(s.max_price, i.imp, (SELECT avg(max_price) FROM subjects)), 6) AS max_price
FROM subjects s LEFT JOIN ({_sql_impute_value(_sql_knn(_Q_MISSING, _D_PRESENT, IMPUTE_COLS, 5), _D_PRESENT, 'max_price')}) i
ON s.key = i.key""")
def q_knn_impute(spark, sf):
    s = subjects(spark, sf).select("key", *IMPUTE_COLS)
    out = impute.knn_impute(s, IMPUTE_COLS, "key", 5)
    return out.select("key", "n_orders", "avg_price", r6("max_price").alias("max_price"))


_Q_NEW = ("SELECT key, n_orders, avg_price, max_price FROM subjects "
          "WHERE label = 1 AND max_price IS NULL")
_D_FIT = ("SELECT key, n_orders, avg_price, max_price FROM subjects "
          "WHERE label = 0 AND max_price IS NOT NULL")


@register("knn_impute_new_rows", SUBJ + f"""
SELECT s.key, s.n_orders, s.avg_price,
       round(coalesce(s.max_price, i.imp, (SELECT avg(max_price) FROM subjects WHERE label = 0)), 6) AS max_price
FROM subjects s LEFT JOIN ({_sql_impute_value(_sql_knn(_Q_NEW, _D_FIT, IMPUTE_COLS, 5), _D_FIT, 'max_price')}) i
ON s.key = i.key
WHERE s.label = 1""")
def q_knn_impute_new_rows(spark, sf):
    s = subjects(spark, sf)
    fitted = impute.fit_knn_imputer(s.where(F.col("label") == 0), IMPUTE_COLS, "key", 5)
    new = s.where(F.col("label") == 1).select("key", *IMPUTE_COLS)
    out = fitted.transform(new)
    return out.select("key", "n_orders", "avg_price", r6("max_price").alias("max_price"))


# ---------------------------------------------------- sampling and SMOTE

from tabrisk.operators import sample, smote  # noqa: E402


def _sql_mode(counts_cte, count_col, draws_sql, name):
    """Largest-remainder allocation of ``draws_sql`` rows over classes (ties by label)."""
    return f"""
{name} AS (
  SELECT label, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM (
    SELECT label, fl, row_number() OVER (ORDER BY cont - fl DESC, label) AS rk,
           ({draws_sql}) - sum(fl) OVER () AS need
    FROM (SELECT label, {count_col} / (SELECT sum({count_col}) FROM {counts_cte}) * ({draws_sql}) AS cont,
                 floor({count_col} / (SELECT sum({count_col}) FROM {counts_cte}) * ({draws_sql})) AS fl
          FROM {counts_cte})))"""


STRAT_SQL = (
    "cc AS (SELECT label, count(*) AS c FROM subjects GROUP BY label),\n"
    "tot AS (SELECT sum(c) AS n, CAST(ceil(CAST(0.05 AS DOUBLE) * sum(c)) AS BIGINT) AS n_test FROM cc),"
    + _sql_mode("cc", "c", "SELECT n - n_test FROM tot", "tr") + ",\n"
    "left_over AS (SELECT cc.label, cc.c - tr.alloc AS c FROM cc JOIN tr ON cc.label = tr.label),"
    + _sql_mode("left_over", "c", "SELECT n_test FROM tot", "te") + f""",
strat AS (
  SELECT s.*, split_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_uniform(42, 'split', 'key')}, key) - 1 AS split_rank
    FROM subjects) s JOIN te ON s.label = te.label
  WHERE split_rank < te.alloc)""")


@register("stratified_sample", SUBJ.rstrip() + ",\n" + STRAT_SQL + """
SELECT key, label, CAST(split_rank AS BIGINT) AS split_rank FROM strat""")
def q_stratified_sample(spark, sf):
    st = sample.stratified_sample(subjects(spark, sf), "label", "key", 0.05, 42)
    return st.select("key", "label", "split_rank")


DIVERSE_BINS = [("n_orders", 5), ("avg_price", 3), ("max_price", 3)]
DIVERSE_STRATA = ["n_orders_bin", "many_orders", "avg_price_bin", "max_price_bin", "top_priority"]
DIVERSE_N = {1: 5, 0: 10}


def _sql_bin_in(col, q, src):
    probs = ", ".join(repr(p) for p in qcut.qcut_probs(q))
    edges = (f"(SELECT list_sort(list_distinct(quantile_cont(i.{col}, [{probs}]))) "
             f"FROM {src} i WHERE i.label = o.label)")
    return (f"CASE WHEN o.{col} IS NULL THEN NULL ELSE "
            f"CAST(greatest(0, len(list_filter({edges}, lambda e: e < o.{col})) - 1) AS INTEGER) END")


DIVERSE_SQL = STRAT_SQL + f""",
sized AS (SELECT s.*, count(*) OVER (PARTITION BY label) AS size,
                 CASE label {" ".join(f"WHEN {c} THEN {n}" for c, n in DIVERSE_N.items())} END AS n
          FROM strat s),
big AS (SELECT * FROM sized WHERE size > n),
binned AS (
  SELECT o.*, {", ".join(f"{_sql_bin_in(c, q, 'big')} AS {c}_bin" for c, q in DIVERSE_BINS)}
  FROM big o),
stratified AS (
  SELECT *, concat_ws('_', {", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in DIVERSE_STRATA)}) AS stratum
  FROM binned),
strata AS (
  SELECT label, stratum, so,
         greatest(0, least(a, n - coalesce(sum(a) OVER (PARTITION BY label ORDER BY so
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
  FROM (SELECT label, stratum, n, least(greatest(1, floor(n / count(*) OVER (PARTITION BY label))), ss) AS a,
               row_number() OVER (PARTITION BY label ORDER BY ss DESC, stratum) AS so
        FROM (SELECT label, stratum, count(*) AS ss, any_value(n) AS n FROM stratified GROUP BY label, stratum))),
first_pass AS (
  SELECT r.key, r.label, 1 AS pass, st.so, CAST(r.rk AS DOUBLE) AS ord FROM (
    SELECT key, label, stratum, row_number() OVER (PARTITION BY label, stratum
                                 ORDER BY {sql_uniform(42, 'stratum', 'key')}, key) AS rk
    FROM stratified) r JOIN strata st ON r.label = st.label AND r.stratum = st.stratum
  WHERE r.rk <= st.take),
got AS (SELECT label, count(*) AS got FROM first_pass GROUP BY label),
second_pass AS (
  SELECT key, label, 2 AS pass, 0 AS so, CAST(rk AS DOUBLE) AS ord FROM (
    SELECT b.key, b.label, b.n - coalesce(g.got, 0) AS need,
           row_number() OVER (PARTITION BY b.label ORDER BY {sql_uniform(42, 'fill', 'b.key')}, b.key) AS rk
    FROM big b LEFT JOIN got g ON b.label = g.label
    WHERE b.key NOT IN (SELECT key FROM first_pass))
  WHERE rk <= need),
whole AS (SELECT key, label, 0 AS pass, 0 AS so, {sql_uniform(42, 'whole', 'key')} AS ord
          FROM sized WHERE size <= n),
chosen AS (
  SELECT key, label, pass, row_number() OVER (PARTITION BY label ORDER BY pass, so, ord, key) - 1 AS p
  FROM (SELECT * FROM first_pass UNION ALL SELECT * FROM second_pass UNION ALL SELECT * FROM whole)),
class_off AS (
  SELECT label, coalesce(sum(k) OVER (ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT label, count(*) AS k,
               CASE label {" ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(DIVERSE_N))} END AS ci
        FROM chosen GROUP BY label)),
diverse AS (
  SELECT c.key, c.label, CAST(c.pass AS INTEGER) AS pass, CAST(o.off + c.p AS INTEGER) AS pos
  FROM chosen c JOIN class_off o ON c.label = o.label)"""


def _diverse(spark, sf):
    st = sample.stratified_sample(subjects(spark, sf), "label", "key", 0.05, 42).drop("split_rank")
    return sample.diverse_sample(st, "label", "key", DIVERSE_N, DIVERSE_BINS, DIVERSE_STRATA, 42)


@register("diverse_sample", SUBJ.rstrip() + ",\n" + DIVERSE_SQL + """
SELECT key, label, pass, pos FROM diverse""")
def q_diverse_sample(spark, sf):
    return _diverse(spark, sf).select("key", "label", "pass", "pos")


SMOTE_FEATURES = ["n_orders", "avg_price", "many_orders"]


def _smote_sql(src="subjects", features=SMOTE_FEATURES):
    u = lambda tag, col: sql_uniform(42, tag, col)
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in features)
    m = f"SELECT key, {cols} FROM {src} WHERE label = 1"
    nn = _sql_knn(m, m, features, 6).replace(
        "WHERE dist IS NOT NULL", "WHERE dist IS NOT NULL AND q_key <> d_key")
    return f""",
m AS ({m}),
nn AS ({nn}),
ranked AS (SELECT key, row_number() OVER (ORDER BY {u('base:1', 'key')}, key) - 1 AS base_rank FROM m),
cnt AS (SELECT (SELECT count(*) FROM {src} WHERE label = 0) AS maj, (SELECT count(*) FROM m) AS nmin),
slots AS (SELECT unnest(generate_series(0, (SELECT maj - nmin - 1 FROM cnt))) AS slot),
draws AS (SELECT slot, CAST(floor({u('pick:1', 'slot')} * (SELECT nmin FROM cnt)) AS BIGINT) AS base_rank,
                 CAST(floor({u('nbr:1', 'slot')} * 5) AS INTEGER) AS nn_rank, {u('step:1', 'slot')} AS step
          FROM slots),
synth AS (
  SELECT 's:1:' || CAST(d.slot AS VARCHAR) AS sample_id, CAST(NULL AS BIGINT) AS key,
         {", ".join(f"b.{c} + d.step * (x.{c} - b.{c}) AS {c}" for c in features)},
         1 AS label, true AS synthetic
  FROM draws d JOIN ranked r ON d.base_rank = r.base_rank JOIN m b ON b.key = r.key
  JOIN nn ON nn.q_key = b.key AND nn.nn_rank = d.nn_rank JOIN m x ON x.key = nn.d_key),
smoted AS (
  SELECT 'o:' || CAST(key AS VARCHAR) AS sample_id, key, {cols}, label, false AS synthetic FROM {src}
  UNION ALL SELECT * FROM synth)"""


# a literal customer without orders: an incomplete row at every size
GAP_ROW = {"key": -1, "segment": "BUILDING", "many_orders": 0, "n_orders": 0.0, "label": 1}
COMPLETE_SQL = """,
with_gap AS (
  SELECT key, n_orders, avg_price, many_orders, label FROM subjects
  UNION ALL SELECT -1, 0.0, NULL, 0, 1),
complete AS (SELECT * FROM with_gap WHERE avg_price IS NOT NULL)"""


def _complete(spark, sf):
    """The rows that have all features; oversampling takes no others."""
    s = subjects(spark, sf).select("key", *SMOTE_FEATURES, "label")
    extra = io.new_rows(spark, [{c: GAP_ROW.get(c) for c in s.columns}], s.schema)
    return s.unionByName(extra).dropna(subset=SMOTE_FEATURES)


@register("smote", SUBJ.rstrip() + COMPLETE_SQL + _smote_sql("complete") + """
SELECT sample_id, CAST(key AS DOUBLE) AS key, round(n_orders, 6) AS n_orders, round(avg_price, 6) AS avg_price,
       CAST(trunc(many_orders) AS INTEGER) AS many_orders, label, synthetic FROM smoted""")
def q_smote(spark, sf):
    s = _complete(spark, sf)
    out = smote.smote(s, "label", "key", SMOTE_FEATURES, k=5, seed=42, discrete_cols=["many_orders"])
    # key is NULL on synthetic rows: reported as double so that both engines
    # hand the same (float, NaN) column to the comparison
    return out.select("sample_id", F.col("key").cast("double").alias("key"), r6("n_orders").alias("n_orders"),
                      r6("avg_price").alias("avg_price"), "many_orders", "label", "synthetic")


@register("class_balance_after_smote", SUBJ.rstrip() + COMPLETE_SQL + _smote_sql("complete") + """
SELECT label, count(*) AS count, count(*) FILTER (WHERE synthetic) AS n_synthetic
FROM smoted GROUP BY label""")
def q_class_balance_after_smote(spark, sf):
    s = _complete(spark, sf)
    out = smote.smote(s, "label", "key", SMOTE_FEATURES, k=5, seed=42, discrete_cols=["many_orders"])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("count"),
                                    F.count_if("synthetic").alias("n_synthetic"))


# ------------------------------------------------ folds, metrics, decisions

from tabrisk.operators import metrics  # noqa: E402


def _scored(spark, sf):
    """Deterministic scores with ties: floor(10 * (0.35 label + 0.65 u)) / 10."""
    s = subjects(spark, sf).select("key", "label")
    s = metrics.with_folds(s, "label", "key", 5, 42)
    u = uniform(42, "score", F.col("key"))
    score = F.floor((F.lit(0.35) * F.col("label") + F.lit(0.65) * u) * 10) / 10
    return s.withColumn("score", score).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


SCORED_SQL = f"""
scored AS (
  SELECT key, label, fold, score, CAST(score >= 0.5 AS INTEGER) AS pred FROM (
    SELECT key, label,
           CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_uniform(42, 'fold', 'key')}, key) - 1) % 5 AS INTEGER) AS fold,
           floor((0.35::DOUBLE * label + 0.65::DOUBLE * {sql_uniform(42, 'score', 'key')}) * 10) / 10 AS score
    FROM subjects))"""

from tabrisk.functions.rnd import uniform  # noqa: E402

AUC_SQL = """
auc AS (
  SELECT fold, CASE WHEN sum(pos) * sum(neg) > 0
                    THEN sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
  FROM (SELECT fold, score, pos, neg,
               coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
        FROM (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY fold, score))
  GROUP BY fold)"""

FOLD_METRICS_SQL = """
fm AS (
  SELECT c.fold, n, tp, fp, fn, tn,
         CASE WHEN n > 0 THEN (tp + tn) / CAST(n AS DOUBLE) ELSE 0 END AS "Accuracy",
         CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS "Precision",
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS "Recall",
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS "F1",
         a.auc AS "ROC-AUC"
  FROM (SELECT fold, count(*) AS n,
               count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
               count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
               count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn
        FROM scored GROUP BY fold) c JOIN auc a ON c.fold = a.fold)"""


@register("stratified_folds", SUBJ.rstrip() + "," + SCORED_SQL + """
SELECT fold, label, count(*) AS n FROM scored GROUP BY fold, label""")
def q_stratified_folds(spark, sf):
    return _scored(spark, sf).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@register("auc_exact", SUBJ.rstrip() + "," + SCORED_SQL + "," + AUC_SQL + """
SELECT fold, round(auc, 6) AS auc FROM auc""")
def q_auc_exact(spark, sf):
    a = metrics.auc_exact(_scored(spark, sf), "label", "score", ["fold"], name="auc")
    return a.select("fold", r6("auc").alias("auc"))


@register("fold_metrics", SUBJ.rstrip() + "," + SCORED_SQL + "," + AUC_SQL + "," + FOLD_METRICS_SQL + """
SELECT fold, n, tp, fp, fn, tn, """ + ", ".join(f'round("{m}", 6) AS "{m}"' for m in metrics.METRIC_NAMES)
    + " FROM fm")
def q_fold_metrics(spark, sf):
    m = metrics.binary_metrics(_scored(spark, sf), "label", "pred", "score", ["fold"])
    return m.select("fold", "n", "tp", "fp", "fn", "tn",
                    *[r6(F.col(f"`{c}`")).alias(c) for c in metrics.METRIC_NAMES])


@register("cv_summary", SUBJ.rstrip() + "," + SCORED_SQL + "," + AUC_SQL + "," + FOLD_METRICS_SQL
    + "\nSELECT " + ", ".join(f'round(avg("{m}"), 6) AS "{m}_mean", round(stddev_pop("{m}"), 6) AS "{m}_std"'
                            for m in metrics.METRIC_NAMES) + " FROM fm")
def q_cv_summary(spark, sf):
    m = metrics.binary_metrics(_scored(spark, sf), "label", "pred", "score", ["fold"])
    s = metrics.cv_summary(m)
    return s.select([r6(F.col(f"`{c}`")).alias(c) for c in s.columns])


@register("threshold_decision", SUBJ.rstrip() + "," + SCORED_SQL + """
SELECT key, score, CAST(score >= 0.1 AS INTEGER) AS decision,
       CASE WHEN score >= 0.1 THEN 'Risk' ELSE 'No Risk' END AS decision_label FROM scored""")
def q_threshold_decision(spark, sf):
    return metrics.decide(_scored(spark, sf), "score", 0.1).select(
        "key", "score", "decision", "decision_label")


# ------------------------------------------------------ preparation plan

from tabrisk.plans.prepare import PrepSpec, prepare  # noqa: E402

SUBJECT_SPEC = PrepSpec(
    key="key", label="label", categorical=["segment", "top_priority"],
    scaled=["n_orders", "avg_price", "max_price"], impute_target="max_price",
    feature_order=["segment", "top_priority", "many_orders", "n_orders", "avg_price", "max_price"])
FEATURES = SUBJECT_SPEC.feature_order
CANDIDATES = ["key", "segment", "top_priority", "many_orders", "n_orders", "avg_price", "max_price", "label"]


def _prepared_sql(fit: str, apply: str) -> str:
    """CTEs ``enc``, ``w`` (selection), ``disp`` (imputed), ``scaled`` for rows fitted on ``fit``."""
    codes = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, category, dense_rank() OVER (ORDER BY category) - 1 AS code "
        f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS category FROM subjects WHERE {fit})"
        for c in SUBJECT_SPEC.categorical)
    sel = ", ".join(
        f"CAST(coalesce(abs({_sql_corr(c, 'max_price')}) > 0.2, false) OR '{c}' = 'max_price' AS INTEGER) AS {c}"
        for c in CANDIDATES)
    q = "SELECT * FROM enc WHERE is_apply AND max_price IS NULL"
    d = "SELECT * FROM enc WHERE is_fit AND max_price IS NOT NULL"
    nn = _sql_knn(q, d, CANDIDATES, 5, weights_cte="w")
    imp = _sql_impute_value(nn, d, "max_price")
    scaled = ", ".join(
        f"(d.{c} - m.{c}_m) / coalesce(nullif(m.{c}_s, 0), 1) AS {c}" for c in SUBJECT_SPEC.scaled)
    moments = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SUBJECT_SPEC.scaled)
    return f""",
codes AS ({codes}),
enc AS (
  SELECT s.key, CAST(cs.code AS DOUBLE) AS segment, CAST(ct.code AS DOUBLE) AS top_priority,
         s.many_orders, s.n_orders, s.avg_price, s.max_price, s.label,
         ({fit}) AS is_fit, ({apply}) AS is_apply
  FROM subjects s
  LEFT JOIN codes cs ON cs.feature = 'segment' AND cs.category = coalesce(s.segment, 'nan')
  LEFT JOIN codes ct ON ct.feature = 'top_priority' AND ct.category = coalesce(s.top_priority, 'nan')),
w AS (SELECT {sel} FROM enc WHERE is_fit),
imp AS ({imp}),
disp AS (
  SELECT e.key, e.segment, e.top_priority, e.many_orders, e.n_orders, e.avg_price,
         coalesce(e.max_price, i.imp, (SELECT avg(max_price) FROM enc WHERE is_fit)) AS max_price,
         e.label, e.is_fit, e.is_apply
  FROM enc e LEFT JOIN imp i ON e.key = i.key),
mom AS (SELECT {moments} FROM disp WHERE is_fit),
scaled AS (
  SELECT d.key, d.segment, d.top_priority, d.many_orders, {scaled}, d.label, d.is_fit, d.is_apply
  FROM disp d, mom m)"""


def _out_cols(df):
    return df.select("key", "segment", "top_priority", F.col("many_orders").cast("double").alias("many_orders"),
                     *[r6(c).alias(c) for c in SUBJECT_SPEC.scaled], "label")


def _sql_out(table):
    return (f"SELECT key, segment, top_priority, CAST(many_orders AS DOUBLE) AS many_orders, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in SUBJECT_SPEC.scaled) + f", label FROM {table}")


@register("prepared_scaled", SUBJ.rstrip() + _prepared_sql("true", "true") + "\n" + _sql_out("scaled"))
def q_prepared_scaled(spark, sf):
    _, scaled, _ = prepare(subjects(spark, sf), SUBJECT_SPEC)
    return _out_cols(scaled)


@register("prepared_display", SUBJ.rstrip() + _prepared_sql("true", "true") + "\n" + _sql_out("disp"))
def q_prepared_display(spark, sf):
    _, _, display = prepare(subjects(spark, sf), SUBJECT_SPEC)
    return _out_cols(display)


@register("apply_and_append", SUBJ.rstrip() + _prepared_sql("label = 0", "true") + "\n"
          + _sql_out("scaled"))
def q_apply_and_append(spark, sf):
    """New rows prepared and appended (X10); a category met in the new rows only has no code."""
    s = subjects(spark, sf)
    fitted, scaled, display = prepare(s.where(F.col("label") == 0), SUBJECT_SPEC)
    new_rows = s.where(F.col("label") == 1)
    all_scaled, _ = fitted.append(scaled, display, new_rows, on_unknown="null")
    return _out_cols(all_scaled)


# ------------------------------------------------ model (rows-only checks)

from tabrisk.functions import dictionaries as D  # noqa: E402
from tabrisk.functions.text import signed4  # noqa: E402
from tabrisk.operators import explain, forest, report  # noqa: E402

SMALL_FOREST = {"n_estimators": 10, "max_depth": 4, "min_samples_leaf": 1, "max_features": "sqrt"}


def _prepared_with_folds(spark, sf):
    _, scaled, _ = prepare(subjects(spark, sf), SUBJECT_SPEC)
    return metrics.with_folds(scaled, "label", "key", 5, 42)


@register("forest_predictions")
def q_forest_predictions(spark, sf):
    data = _prepared_with_folds(spark, sf)
    model = forest.fit_forest(data, FEATURES, "label", SMALL_FOREST)
    scored = forest.predict(data, model, FEATURES)
    return metrics.decide(scored, "prob", D.DECISION_THRESHOLD).select(
        "key", "label", "prob", "pred", "decision", "decision_label")


@register("forest_cv_metrics")
def q_forest_cv_metrics(spark, sf):
    data = _prepared_with_folds(spark, sf)
    return forest.cross_validate(data, FEATURES, "label", SMALL_FOREST, "fold", 5)


@register("grid_search")
def q_grid_search(spark, sf):
    data = _prepared_with_folds(spark, sf)
    # sqrt and log2 of six features are one parameter, so the candidates differ elsewhere
    grid = {"n_estimators": [5, 10], "max_depth": [3, 5], "min_samples_leaf": [1, 20], "max_features": ["sqrt"]}
    _, table = forest.grid_search(spark, data, FEATURES, "label", grid, "fold", parallelism=2)
    return table


@register("feature_importance")
def q_feature_importance(spark, sf):
    data = _prepared_with_folds(spark, sf)
    model = forest.fit_forest(data, FEATURES, "label", SMALL_FOREST)
    return forest.feature_importance(spark, model, FEATURES, 10)


@register("shap_values")
def q_shap_values(spark, sf):
    data = _prepared_with_folds(spark, sf)
    model = forest.fit_forest(data, FEATURES, "label", SMALL_FOREST)
    return explain.tree_shap(data, explain.forest_nodes(model), FEATURES, "key")


@register("shap_stump", SUBJ.rstrip() + """,
st AS (
  SELECT t, count(*) AS n, count(*) FILTER (WHERE avg_price <= t) AS nl,
         sum(label) FILTER (WHERE avg_price <= t) AS pl, sum(label) FILTER (WHERE avg_price > t) AS pr,
         sum(label) AS p
  FROM subjects, (SELECT avg(avg_price) AS t FROM subjects) GROUP BY t)
SELECT key, round(p / n, 6) AS base_value,
       round(CASE WHEN avg_price <= t THEN pl / nl ELSE pr / (n - nl) END, 6) AS prediction,
       0.0 AS shap_n_orders,
       round(CASE WHEN avg_price <= t THEN pl / nl ELSE pr / (n - nl) END - p / n, 6) AS shap_avg_price
FROM subjects, st""")
def q_shap_stump(spark, sf):
    s = subjects(spark, sf)
    nodes = explain.stump_nodes(s, "avg_price", 1, "label", F.avg("avg_price"))
    sh = explain.tree_shap(s, nodes, ["n_orders", "avg_price"], "key")
    return sh.select("key", r6("base_value").alias("base_value"), r6("prediction").alias("prediction"),
                     r6(F.col("shap")[0]).alias("shap_n_orders"), r6(F.col("shap")[1]).alias("shap_avg_price"))


# ------------------------------------------- attributions and report text

# This repository's linear scorer over the prepared table: its exact
# attributions w_j (x_j - mean_j) drive the report chain with an oracle.
LINEAR_WEIGHTS = {"segment": 0.015, "top_priority": -0.02, "many_orders": 0.04,
                  "n_orders": 0.05, "avg_price": -0.03, "max_price": 0.06}
LINEAR_INTERCEPT = 0.08


def _explained(spark, sf):
    fitted, scaled, display = prepare(subjects(spark, sf), SUBJECT_SPEC)
    # reference point: the origin of the prepared features (exact products)
    shap = explain.linear_shap(scaled, "key", LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    return fitted, scaled, display, shap


def _sql_lit(x):
    return f"CAST({x!r} AS DOUBLE)"


ATT_SQL = ",\natt AS (" + " UNION ALL ".join(
        f"SELECT s.key, {i} AS feature_pos, '{c}' AS feature, CAST(s.{c} AS DOUBLE) AS value_scaled, "
        f"CAST(d.{c} AS DOUBLE) AS value_original, "
        f"{_sql_lit(LINEAR_WEIGHTS[c])} * s.{c} AS shap_value "
        f"FROM scaled s JOIN disp d ON s.key = d.key"
        for i, c in enumerate(FEATURES)) + "),\n" + \
    "top AS (SELECT * FROM (SELECT key, feature_pos, feature, shap_value, row_number() OVER " \
    "(PARTITION BY key ORDER BY shap_value DESC, feature_pos) AS reason_rank FROM att WHERE shap_value > 0) " \
    "WHERE reason_rank <= 3),\n" + \
    "names AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, '{v}' AS display_name"
                                       for k, v in D.SUBJECT_DISPLAY_NAMES.items()) + ")"
PREP_ALL = SUBJ.rstrip() + _prepared_sql("true", "true")


@register("attribution_table", PREP_ALL + ATT_SQL + """
SELECT key, feature_pos, feature, round(value_scaled, 6) AS value_scaled,
       round(value_original, 6) AS value_original, round(shap_value, 6) AS shap_value,
       round(abs(shap_value), 6) AS abs_shap FROM att""")
def q_attribution_table(spark, sf):
    _, scaled, display, shap = _explained(spark, sf)
    a = explain.attributions(shap, scaled, display, "key", FEATURES)
    return a.select("key", "feature_pos", "feature", *[r6(c).alias(c) for c in
                                                      ["value_scaled", "value_original", "shap_value", "abs_shap"]])


@register("top_reasons", PREP_ALL + ATT_SQL + """
SELECT key, CAST(reason_rank AS INTEGER) AS reason_rank, feature_pos, feature,
       round(shap_value, 6) AS shap_value FROM top""")
def q_top_reasons(spark, sf):
    _, _, _, shap = _explained(spark, sf)
    t = explain.top_reasons(shap, "key", FEATURES, 3)
    return t.select("key", "reason_rank", "feature_pos", "feature", r6("shap_value").alias("shap_value"))


@register("sorted_attributions", PREP_ALL + ATT_SQL + """
SELECT a.key, a.feature,
       CAST(row_number() OVER (PARTITION BY a.key ORDER BY abs(a.shap_value) DESC, a.feature_pos) AS INTEGER) AS impact_rank,
       n.display_name || ': ' || printf('%+.4f', a.shap_value) AS line
FROM att a JOIN names n ON a.feature = n.feature""")
def q_sorted_attributions(spark, sf):
    _, scaled, display, shap = _explained(spark, sf)
    a = explain.sorted_attributions(explain.attributions(shap, scaled, display, "key", FEATURES), "key")
    names = F.create_map(*[x for k, v in D.SUBJECT_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return a.select("key", "feature", "impact_rank",
                    F.concat(F.element_at(names, F.col("feature")), F.lit(": "), signed4("shap_value")).alias("line"))


@register("reason_list", PREP_ALL + ATT_SQL + """
SELECT t.key, string_agg(n.display_name, ', ' ORDER BY t.reason_rank) AS reasons
FROM top t JOIN names n ON t.feature = n.feature GROUP BY t.key""")
def q_reason_list(spark, sf):
    _, _, _, shap = _explained(spark, sf)
    return report.reason_list(explain.top_reasons(shap, "key", FEATURES, 3), "key", D.SUBJECT_DISPLAY_NAMES)


def _sql_block():
    def cat(c):
        return (f"coalesce((SELECT category FROM codes WHERE feature = '{c}' AND code = CAST(trunc(d.{c}) AS INTEGER)), "
                f"CAST(d.{c} AS VARCHAR))")
    lines = {
        "segment": cat("segment"), "top_priority": cat("top_priority"),
        "many_orders": "CASE CAST(trunc(d.many_orders) AS INTEGER) WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END",
        "n_orders": "CAST(CAST(trunc(d.n_orders) AS BIGINT) AS VARCHAR) || ' orders'",
        "avg_price": "printf('%.1f', d.avg_price) || ' USD'",
        "max_price": "printf('%.1f', d.max_price) || ' USD'",
    }
    return " || chr(10) || ".join(f"'{D.SUBJECT_DISPLAY_NAMES[c]}: ' || {lines[c]}" for c in FEATURES)


SHOWN = ["many_orders", "n_orders", "avg_price", "max_price"]


@register("format_values", SUBJ + " UNION ALL ".join(
    f"SELECT key, '{c}' AS feature, {e} AS shown FROM subjects" for c, e in {
        "many_orders": "CASE many_orders WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END",
        "n_orders": "CAST(CAST(trunc(n_orders) AS BIGINT) AS VARCHAR) || ' orders'",
        "avg_price": "printf('%.1f', avg_price) || ' USD'", "max_price": "printf('%.1f', max_price) || ' USD'"}.items()))
def q_format_values(spark, sf):
    """Values of several features in one column, shown by the rule of their feature."""
    from tabrisk.functions.text import format_value
    long = subjects(spark, sf).select("key", *[F.col(c).cast("double").alias(c) for c in SHOWN]).unpivot(
        ["key"], SHOWN, "feature", "value")
    return long.select("key", "feature", format_value("feature", "value", D.SUBJECT_VALUE_LABELS, D.SUBJECT_RULES).alias("shown"))


def _subject_blocks(fitted, display):
    """Record blocks of display rows; encoded categories are decoded by a join."""
    for c in SUBJECT_SPEC.categorical:
        display = fitted.encoder.decode(display, c, c)
    labels = {c: v for c, v in D.SUBJECT_VALUE_LABELS.items() if c not in SUBJECT_SPEC.categorical}
    return report.feature_block(display, FEATURES, D.SUBJECT_DISPLAY_NAMES, labels, D.SUBJECT_RULES)


@register("feature_block", PREP_ALL + f"""
SELECT d.key, {_sql_block()} AS feature_block FROM disp d""")
def q_feature_block(spark, sf):
    fitted, _, display, _ = _explained(spark, sf)
    return _subject_blocks(fitted, display).select("key", "feature_block")


def _prompt_frame(spark, sf):
    fitted, _, display, shap = _explained(spark, sf)
    fb = _subject_blocks(fitted, display).select("key", "feature_block")
    sh = shap.withColumn("reasons", report.reasons_inline("shap", FEATURES, D.SUBJECT_DISPLAY_NAMES, 3))
    sh = metrics.decide(sh, "prediction", D.DECISION_THRESHOLD, labels=D.STATUS_LABELS)
    return report.prompts(sh.join(fb, "key"))


def _sql_str(s):
    return "'" + s.replace("'", "''") + "'"


@register("prompts", PREP_ALL + ATT_SQL + f""",
pred AS (SELECT s.key, {_sql_lit(LINEAR_INTERCEPT)} + """
          + " + ".join(f"{_sql_lit(LINEAR_WEIGHTS[c])} * s.{c}" for c in FEATURES) + f""" AS prediction
         FROM scaled s),
rl AS (SELECT t.key, string_agg(n.display_name, ', ' ORDER BY t.reason_rank) AS reasons
       FROM top t JOIN names n ON t.feature = n.feature GROUP BY t.key),
blk AS (SELECT d.key, {_sql_block()} AS feature_block FROM disp d)
SELECT p.key, {_sql_str(D.SYSTEM_PROMPT)} AS system_prompt,
       replace(replace(replace({_sql_str(D.USER_PROMPT_TEMPLATE)},
               '{{top_feature_list}}', coalesce(rl.reasons, '')),
               '{{risk_label}}', CASE WHEN p.prediction >= 0.1 THEN 'Risk' ELSE 'No Risk' END),
               '{{patient_feature_block}}', b.feature_block) AS user_prompt
FROM pred p JOIN blk b ON p.key = b.key LEFT JOIN rl ON p.key = rl.key""")
def q_prompts(spark, sf):
    return _prompt_frame(spark, sf).select("key", "system_prompt", "user_prompt")


# The in-process client answers from the prompt alone, so SQL can do the same.
ECHO_SQL = ORACLES["prompts"].replace("SELECT p.key,", "SELECT p.key AS key,", 1)
_head, _tail = ECHO_SQL.rsplit("\nSELECT p.key", 1)
ECHO_SQL = _head + f""",
pr AS (SELECT p.key{_tail}),
echo AS (
  SELECT key, regexp_extract(user_prompt, '"(The input features[^"]*)"', 1)
         || CASE WHEN regexp_matches(user_prompt, 'Predicted Stroke Status: (.*)\\n\\nPatient Data')
                 THEN chr(10) || chr(10) || 'Overall Summary: '
                      || regexp_extract(user_prompt, 'Predicted Stroke Status: (.*)\\n\\nPatient Data', 1) ELSE '' END AS text,
         len(regexp_extract_all(system_prompt || ' ' || user_prompt, '\\S+')) AS p
  FROM pr)"""


@register("completions", ECHO_SQL + """
SELECT key, text AS completion FROM echo""")
def q_completions(spark, sf):
    return report.complete(_prompt_frame(spark, sf), report.EchoClient, "key")


@register("completions_with_metadata", ECHO_SQL + """
SELECT key, text, CAST(p AS INTEGER) AS prompt_tokens, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS completion_tokens,
       CAST(p + len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS total_tokens, 'echo-1' AS model, 'stop' AS finish_reason
FROM echo""")
def q_completions_with_metadata(spark, sf):
    out = report.complete(_prompt_frame(spark, sf), report.EchoClient, "key", with_metadata=True)
    return out.select("key", "completion.text", "completion.usage.*", "completion.model", "completion.finish_reason")


# ------------------------------------------------- NULL groups and several gaps

GROUPED_SQL = "grouped AS (SELECT *, CASE WHEN key % 7 > 0 THEN segment END AS grp FROM subjects)"


@register("quantiles_null_group", SUBJ.rstrip() + ",\n" + GROUPED_SQL + "\n" + " UNION ALL ".join(
    f"SELECT grp, {i} AS q_index, round(quantile_cont(avg_price, {p}), 6) AS quantile FROM grouped GROUP BY grp"
    for i, p in enumerate((0.1, 0.5, 0.9))))
def q_quantiles_null_group(spark, sf):
    from tabrisk.operators.quantiles import exact_quantiles
    s = subjects(spark, sf).withColumn("grp", F.when(F.col("key") % 7 > 0, F.col("segment")))
    return exact_quantiles(s, "avg_price", [0.1, 0.5, 0.9], ["grp"]).select("grp", "q_index", r6("quantile").alias("quantile"))


@register("fold_metrics_null_fold", SUBJ.rstrip() + "," + SCORED_SQL.replace(
    "scored AS (", "scored AS (SELECT * REPLACE (CASE WHEN fold < 4 THEN fold END AS fold) FROM (", 1).rstrip() + ")" + ","
    + AUC_SQL + "," + FOLD_METRICS_SQL.replace("ON c.fold = a.fold", "ON c.fold IS NOT DISTINCT FROM a.fold") + """
SELECT CAST(fold AS DOUBLE) AS fold, n, tp, fp, fn, tn, """ + ", ".join(f'round("{m}", 6) AS "{m}"' for m in metrics.METRIC_NAMES)
    + " FROM fm")
def q_fold_metrics_null_fold(spark, sf):
    scored = _scored(spark, sf).withColumn("fold", F.when(F.col("fold") < 4, F.col("fold")))
    m = metrics.binary_metrics(scored, "label", "pred", "score", ["fold"])
    return m.select(F.col("fold").cast("double").alias("fold"), "n", "tp", "fp", "fn", "tn",
                    *[r6(F.col(f"`{c}`")).alias(c) for c in metrics.METRIC_NAMES])


GAPS_SQL = """gaps AS (
  SELECT key, n_orders, CASE WHEN key % 11 > 0 THEN avg_price END AS avg_price, max_price FROM subjects)"""


def _gappy(spark, sf):
    return subjects(spark, sf).select(
        "key", "n_orders", F.when(F.col("key") % 11 > 0, F.col("avg_price")).alias("avg_price"), "max_price")


def _sql_gap_impute(c):
    q, d = (f"SELECT * FROM gaps WHERE {c} IS {n} NULL" for n in ("", "NOT"))
    return f"({_sql_impute_value(_sql_knn(q, d, IMPUTE_COLS, 5), d, c)})"


@register("knn_impute_two_gaps", SUBJ.rstrip() + ",\n" + GAPS_SQL + f"""
SELECT s.key, s.n_orders,
       round(coalesce(s.avg_price, a.imp, (SELECT avg(avg_price) FROM gaps)), 6) AS avg_price,
       round(coalesce(s.max_price, m.imp, (SELECT avg(max_price) FROM gaps)), 6) AS max_price
FROM gaps s LEFT JOIN {_sql_gap_impute('avg_price')} a ON s.key = a.key
LEFT JOIN {_sql_gap_impute('max_price')} m ON s.key = m.key""")
def q_knn_impute_two_gaps(spark, sf):
    out = impute.knn_impute(_gappy(spark, sf), IMPUTE_COLS, "key", 5)
    return out.select("key", "n_orders", r6("avg_price").alias("avg_price"), r6("max_price").alias("max_price"))


@register("knn_join_gap_patterns", SUBJ.rstrip() + ",\n" + GAPS_SQL + f"""
SELECT q_key, d_key, round(dist, 6) AS dist, CAST(nn_rank AS INTEGER) AS nn_rank FROM (
{_sql_knn("SELECT 'k' || key AS key, n_orders, avg_price, max_price FROM gaps WHERE avg_price IS NULL OR max_price IS NULL",
          "SELECT 'k' || key AS key, n_orders, avg_price, max_price FROM gaps", IMPUTE_COLS, 3)})""")
def q_knn_join_gap_patterns(spark, sf):
    g = _gappy(spark, sf).withColumn("key", F.concat(F.lit("k"), F.col("key").cast("string")))
    nn = knn.knn_join(g.where(F.col("avg_price").isNull() | F.col("max_price").isNull()), g, IMPUTE_COLS, 3)
    return nn.select("q_key", "d_key", r6("dist").alias("dist"), "nn_rank")


# ------------------------------------------------------------ sources and sinks

import uuid  # noqa: E402

from tabrisk.session import checkpoint_dir  # noqa: E402

_SUBJECT_TYPES = ("key bigint, segment string, top_priority string, many_orders int, n_orders double, "
                  "avg_price double, max_price double, label int")
_SUBJECT_ROWS = "SELECT key, segment, top_priority, many_orders, n_orders, avg_price, CAST(max_price AS DOUBLE) AS max_price, label FROM subjects"


def _scratch(spark):
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@register("csv_round_trip", SUBJ + _SUBJECT_ROWS)
def q_csv_round_trip(spark, sf):
    """Write as CSV with a header, check that it is there, read it typed."""
    path = _scratch(spark)
    io.write_table(subjects(spark, sf), path, fmt="csv")
    io.require_inputs(spark, [path])
    return io.read_table(spark, path, schema=_SUBJECT_TYPES)


@register("append_current", SUBJ + _SUBJECT_ROWS)
def q_append_current(spark, sf):
    """Two appends, then the table as it is."""
    path, s = _scratch(spark), subjects(spark, sf)
    io.append_with_backup(s.where(F.col("label") == 0), path)
    io.append_with_backup(s.where(F.col("label") == 1), path, writer="new-rows")
    io.append_with_backup(s.where(F.col("label") == 1), path, writer="new-rows")  # a retry
    return io.read_current(spark, path)


@register("append_backup", SUBJ + _SUBJECT_ROWS + " WHERE label = 0")
def q_append_backup(spark, sf):
    """The table as it was before the last append."""
    path, s = _scratch(spark), subjects(spark, sf)
    io.append_with_backup(s.where(F.col("label") == 0), path)
    io.append_with_backup(s.where(F.col("label") == 1), path)
    return io.read_backup(spark, path)


@register("saved_preparation", SUBJ.rstrip() + _prepared_sql("label = 0", "true") + "\n" + _sql_out("scaled") + " WHERE label = 1")
def q_saved_preparation(spark, sf):
    """Fitted state saved, loaded and applied to the rows it was not fitted on."""
    from tabrisk.plans.prepare import FittedPrep
    path, s = _scratch(spark), subjects(spark, sf)
    fitted, _, _ = prepare(s.where(F.col("label") == 0), SUBJECT_SPEC)
    fitted.save(spark, path)
    scaled, _ = FittedPrep.load(spark, path).apply(s.where(F.col("label") == 1), on_unknown="null")
    return _out_cols(scaled)


@register("new_row_view", SUBJ.rstrip() + _prepared_sql("label = 0", "true") + """
SELECT s.key, round(s.max_price, 6) AS scaled_max_price, round(d.max_price, 6) AS max_price
FROM scaled s JOIN disp d ON s.key = d.key WHERE s.label = 1""")
def q_new_row_view(spark, sf):
    """Scaled and display values of the appended rows only (R2)."""
    s = subjects(spark, sf)
    fitted, _, _ = prepare(s.where(F.col("label") == 0), SUBJECT_SPEC)
    scaled, display = fitted.apply(s.where(F.col("label") == 1), on_unknown="null")
    return scaled.select("key", r6("max_price").alias("scaled_max_price")).join(
        display.select("key", r6("max_price").alias("max_price")), "key")


# ----------------------------------------------- checks of models with known answers


@register("forest_checks", SUBJ + """
SELECT 'importances sum to 1' AS check_name, true AS holds UNION ALL
SELECT 'node table scores like the model', true UNION ALL
SELECT 'attributions add up to the probability', true UNION ALL
SELECT 'saved model predicts the same', true UNION ALL
SELECT 'every fold is scored once', true""")
def q_forest_checks(spark, sf):
    """What must hold for any fitted forest, as booleans over the whole table."""
    data = cut_lineage(_prepared_with_folds(spark, sf))
    model = forest.fit_forest(data, FEATURES, "label", SMALL_FOREST)
    path = _scratch(spark)
    io.save_model(spark, model, path, FEATURES, SMALL_FOREST)
    back, _, _ = io.load_model(spark, path)
    prob = forest.predict(data, model, FEATURES).select("key", "prob")
    again = forest.predict(data, back, FEATURES).select("key", F.col("prob").alias("prob2"))
    shap = explain.tree_shap(data, explain.forest_nodes(model), FEATURES, "key")
    total = F.aggregate("shap", F.col("base_value"), lambda a, x: a + x)
    each = prob.join(again, "key").join(shap, "key").agg(
        F.max(F.abs(F.col("prob") - F.col("prediction"))).alias("nodes"), F.max(F.abs(total - F.col("prob"))).alias("sums"),
        F.max(F.abs(F.col("prob") - F.col("prob2"))).alias("saved"))
    imp = forest.feature_importance(spark, model, FEATURES, len(FEATURES)).agg(F.sum("importance").alias("s"))
    folds = forest.cross_validate(data, FEATURES, "label", SMALL_FOREST, "fold", 5).agg(F.sum("n").alias("n"))
    rows = data.agg(F.count(F.lit(1)).alias("rows"))
    one = each.crossJoin(imp).crossJoin(folds).crossJoin(rows)  # one row each
    checks = {"importances sum to 1": F.abs(F.col("s") - 1) < 1e-9, "node table scores like the model": F.col("nodes") < 1e-9,
              "attributions add up to the probability": F.col("sums") < 1e-9,
              "saved model predicts the same": F.col("saved") < 1e-12, "every fold is scored once": F.col("n") == F.col("rows")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("holds"))
                                          for k, v in checks.items()])).alias("c")).select("c.*")


# ------------------------------------------------------------- training plan

from tabrisk.plans import train as training  # noqa: E402


def _training_table(s):
    _, scaled, _ = prepare(s, SUBJECT_SPEC)
    keys = sample.stratified_sample(s, "label", "key", 0.05, 42).select("key")
    return training.training_table(scaled, keys, "label", "key", FEATURES, 5, 42, ["many_orders"])


@register("training_table", SUBJ.rstrip() + _prepared_sql("true", "true") + ",\n" + STRAT_SQL + """,
rest AS (SELECT * FROM scaled WHERE key NOT IN (SELECT key FROM strat))""" + _smote_sql("rest", FEATURES) + """
SELECT sample_id, CAST(key AS DOUBLE) AS key, """ + ", ".join(
    f"CAST(trunc({c}) AS INTEGER) AS {c}" if c == "many_orders" else f"round({c}, 5) AS {c}" for c in FEATURES) + """,
       label, synthetic FROM smoted""")
def q_training_table(spark, sf):
    """Prepared rows without the sampled ones, oversampled on all features (M8, M11, Entry 1 and 2)."""
    out = _training_table(cut_lineage(subjects(spark, sf)))
    return out.select("sample_id", F.col("key").cast("double").alias("key"),
                      *[F.col(c) if c == "many_orders" else F.round(c, 5).alias(c) for c in FEATURES], "label", "synthetic")


TRAIN_GRID = {"n_estimators": [5], "max_depth": [2, 4], "max_features": ["sqrt"]}


@register("training_checks", """
SELECT 'best candidate has the highest recall' AS check_name, true AS holds UNION ALL
SELECT 'every resampled row is scored once', true UNION ALL
SELECT 'summary is the mean over the folds', true UNION ALL
SELECT 'classes are equal', true UNION ALL
SELECT 'sample and training rows are disjoint', true UNION ALL
SELECT 'within-fold resampling scores original rows only', true""")
def q_training_checks(spark, sf):
    """The training plan run on the resampled table, and what must hold of it."""
    s = cut_lineage(subjects(spark, sf))  # prepared once, sampled twice
    table = cut_lineage(_training_table(s))
    got = training.train(table, "label", FEATURES, TRAIN_GRID, folds=3, path=_scratch(spark))
    inner = training.train(table, "label", FEATURES, {**TRAIN_GRID, "max_depth": [3]}, folds=2, resample_within_fold=True,
                           smote_k=3, shuffle=False)
    best = got.grid.agg(F.max("mean_recall").alias("top"),
                        F.max(F.when(F.col("params") == json.dumps(got.best), F.col("mean_recall"))).alias("best"))
    folds = got.folds.agg(F.sum("n").alias("n"), F.avg("Recall").alias("recall"))
    summary = got.summary.select("Recall_mean")
    counts = table.agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("share"),
                       F.count_if(~F.col("synthetic")).alias("originals"))
    both = sample.stratified_sample(s, "label", "key", 0.05, 42).select("key").join(table, "key").agg(F.count(F.lit(1)).alias("both"))
    held = inner.folds.agg(F.sum("n").alias("held"))
    one = best
    for part in (folds, summary, counts, both, held):  # one row each
        one = one.crossJoin(part)
    checks = {"best candidate has the highest recall": F.col("top") == F.col("best"),
              "every resampled row is scored once": F.col("n") == F.col("rows"),
              "summary is the mean over the folds": F.abs(F.col("recall") - F.col("Recall_mean")) < 1e-9,
              "classes are equal": F.col("share") == 0.5, "sample and training rows are disjoint": F.col("both") == 0,
              "within-fold resampling scores original rows only": F.col("held") == F.col("originals")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("holds"))
                                          for k, v in checks.items()])).alias("c")).select("c.*")


def _shap_explained(spark, sf):
    """Forest SHAP of the prepared rows (E2), the display table and the fitted state."""
    fitted, scaled, display = prepare(subjects(spark, sf), SUBJECT_SPEC)
    model = forest.fit_forest(scaled, FEATURES, "label", SMALL_FOREST)
    return fitted, display, explain.tree_shap(scaled, explain.forest_nodes(model), FEATURES, "key")


@register("shap_reasons")
def q_shap_reasons(spark, sf):
    _, _, shap = _shap_explained(spark, sf)
    return explain.top_reasons(shap, "key", FEATURES, 3)


@register("shap_prompts")
def q_shap_prompts(spark, sf):
    """Prompts whose reasons are the forest's own attributions."""
    fitted, display, shap = _shap_explained(spark, sf)
    sh = shap.withColumn("reasons", report.reasons_inline("shap", FEATURES, D.SUBJECT_DISPLAY_NAMES, 3))
    sh = metrics.decide(sh, "prediction", D.DECISION_THRESHOLD, labels=D.STATUS_LABELS)
    blocks = _subject_blocks(fitted, display).select("key", "feature_block")
    return report.prompts(sh.join(blocks, "key")).select("key", "system_prompt", "user_prompt")


# ------------------------------------------------- first rows, literal rows, cards

from tabrisk.operators import nodes, ranking  # noqa: E402

_FIRST_COLS = "key, segment, n_orders, label"


@register("head_rows", SUBJ + f"SELECT {_FIRST_COLS} FROM subjects ORDER BY key LIMIT 5")
def q_head_rows(spark, sf):
    """A preview: the first five records."""
    return ranking.head(subjects(spark, sf), "key", 5).select(*_FIRST_COLS.split(", "))


@register("first_rows", SUBJ + f"""
SELECT {_FIRST_COLS} FROM subjects QUALIFY row_number() OVER (PARTITION BY segment ORDER BY key) <= 3""")
def q_first_rows(spark, sf):
    """The first three records of each segment (T4)."""
    return ranking.first_n(subjects(spark, sf), "key", 3, "segment").select(*_FIRST_COLS.split(", "))


@register("last_row", SUBJ + f"""
SELECT {_FIRST_COLS}, 'all' AS of FROM subjects WHERE key = (SELECT max(key) FROM subjects)
UNION ALL SELECT {_FIRST_COLS}, 'segment' FROM subjects QUALIFY row_number() OVER (PARTITION BY segment ORDER BY key DESC) = 1""")
def q_last_row(spark, sf):
    """The last record, and the last of each segment (T4)."""
    s = subjects(spark, sf).select(*_FIRST_COLS.split(", "))
    return ranking.last_row(s, "key").withColumn("of", F.lit("all")).unionByName(
        ranking.last_row(s, "key", "segment").withColumn("of", F.lit("segment")))


LITERAL_ROWS = [(-1, "BUILDING", "1-URGENT", 0, 3.0, 1000.5, None, 1), (-2, "MACHINERY", "5-LOW", 1, 12.0, 2500.25, 9000.0, 0)]


@register("literal_rows", SUBJ + _SUBJECT_ROWS + " UNION ALL SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else repr(v) for v in r) + ")" for r in LITERAL_ROWS) + ") v")
def q_literal_rows(spark, sf):
    """The records with two typed in by hand."""
    s = subjects(spark, sf)
    return s.unionByName(io.new_rows(spark, LITERAL_ROWS, _SUBJECT_TYPES))


@register("record_cards", PREP_ALL + f"""
SELECT d.key, 'Index: ' || d.key || chr(10) || 'Actual status: '
       || CASE WHEN d.label = 1 THEN 'Risk' ELSE 'No Risk' END || chr(10) || {_sql_block()} AS card FROM disp d""")
def q_record_cards(spark, sf):
    """Index, actual label and shown values of every record."""
    fitted, _, display, _ = _explained(spark, sf)
    return report.record_card(_subject_blocks(fitted, display), "key", "label").select("key", "card")


class _Flaky(report.EchoClient):
    """Fails on every third length of prompt."""

    def chat(self, system, user, **options):
        if len(user) % 3 == 0:
            raise RuntimeError("unavailable")
        return super().chat(system, user, **options)


@register("completions_resumed", ECHO_SQL + """
SELECT e.key, e.text, CASE WHEN length(pr.user_prompt) % 3 = 0 THEN 'second' ELSE 'first' END AS run
FROM echo e JOIN pr ON e.key = pr.key""")
def q_completions_resumed(spark, sf):
    """Answers kept from a run whose client failed on some rows, the rest asked for in a second."""
    path, frame = _scratch(spark), cut_lineage(_prompt_frame(spark, sf))
    report.complete_once(frame, _Flaky, "key", path, run="first")
    out = report.complete_once(frame, report.EchoClient, "key", path, chunks=2, run="second")
    return out.select("key", F.col("completion.text").alias("text"), "run")


# ----------------------------------------------------- node tables with known answers

TWO_LEVEL_SQL = """,
m AS (SELECT avg(avg_price) AS t FROM complete),
side AS (SELECT label, avg_price <= t AS l, n_orders <= 8 AS few FROM complete, m),
tree AS (
  SELECT 0 AS node_id, 0 AS depth, false AS tip, count(*) AS cover, sum(label) AS pos FROM side
  UNION ALL SELECT 1, 1, false, count(*), sum(label) FROM side WHERE l
  UNION ALL SELECT 2, 2, true, count(*), sum(label) FROM side WHERE l AND few
  UNION ALL SELECT 3, 2, true, count(*), sum(label) FROM side WHERE l AND NOT few
  UNION ALL SELECT 4, 1, true, count(*), sum(label) FROM side WHERE NOT l)"""


def _two_level(spark, sf):
    """A tree set by hand: price at its mean, then orders at 8, with the records' covers and shares."""
    s = _complete(spark, sf)
    mean = s.agg(F.avg("avg_price").alias("_t"))
    sides = s.join(F.broadcast(mean)).withColumns({"_l": F.col("avg_price") <= F.col("_t"), "_few": F.col("n_orders") <= 8})
    left, few = F.col("_l"), F.col("_few")
    within = {0: F.lit(True), 1: left, 2: left & few, 3: left & ~few, 4: ~left}
    got = sides.agg(F.first("_t").alias("t"), *[x for i, w in within.items() for x in (
        F.count_if(w).alias(f"n{i}"), F.sum(F.when(w, F.col("label"))).alias(f"p{i}"))])
    shape = {0: (1, 4, 1), 1: (2, 3, 0), 2: (-1, -1, -1), 3: (-1, -1, -1), 4: (-1, -1, -1)}  # left, right, feature
    rows = [F.struct(F.lit(0).alias("tree_id"), F.lit(i).alias("node_id"), F.lit(a).alias("left"), F.lit(b).alias("right"),
                     F.lit(f).alias("feature"), (F.col("t") if f == 1 else F.lit(8.0) if f == 0 else F.lit(None).cast("double")).alias("threshold"),
                     F.array().cast("array<double>").alias("categories"), F.lit(-1).alias("num_categories"),
                     (F.col(f"p{i}") / F.col(f"n{i}")).alias("value"), F.col(f"n{i}").cast("double").alias("cover"))
            for i, (a, b, f) in shape.items()]
    return s, got.select(F.explode(F.array(*rows)).alias("n")).select("n.*")


# name -> (split bound as SQL over the left side's cover, depth)
CUTS = {"whole": ("2", None), "split bound": ("nl + 1", None), "depth 1": ("2", 1), "root only": ("1000000000", None)}


def _cut_sql(select):
    return "\nUNION ALL ".join(
        "SELECT " + select.format(name=name, depth=99 if depth is None else depth, bound=bound)
        for name, (bound, depth) in CUTS.items())


@register("pruned_nodes", SUBJ.rstrip() + COMPLETE_SQL + TWO_LEVEL_SQL + """,
b AS (SELECT cover AS nl, (SELECT cover FROM tree WHERE node_id = 0) AS n FROM tree WHERE node_id = 1)
""" + _cut_sql("""'{name}' AS cut, node_id, tip OR depth >= {depth} OR cover < {bound} AS leaf, CAST(cover AS DOUBLE) AS cover,
       round(pos / CAST(cover AS DOUBLE), 6) AS value
FROM tree, b WHERE depth <= {depth} AND (depth = 0 OR n >= {bound}) AND (depth < 2 OR nl >= {bound})"""))
def q_pruned_nodes(spark, sf):
    """Covers, shares and leaves of a node table before and after ``min_samples_split`` and depth cuts (M2, M4)."""
    _, tree = _two_level(spark, sf)
    tree = cut_lineage(tree)
    nl = tree.where("node_id = 1").first()["cover"]
    out = None
    for name, (bound, depth) in CUTS.items():
        split = int(nl) + 1 if "nl" in bound else int(bound)
        part = nodes.prune(tree, split, depth).select(
            F.lit(name).alias("cut"), "node_id", (F.col("left") < 0).alias("leaf"), "cover", r6("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@register("derived_scores", SUBJ.rstrip() + COMPLETE_SQL + TWO_LEVEL_SQL + """,
b AS (SELECT cover AS nl, (SELECT cover FROM tree WHERE node_id = 0) AS n FROM tree WHERE node_id = 1),
v AS (SELECT node_id, pos / CAST(cover AS DOUBLE) AS value FROM tree)
""" + _cut_sql("""c.key, '{name}' AS cut, round((SELECT value FROM v WHERE node_id = CASE
       WHEN n < {bound} OR {depth} < 1 THEN 0 WHEN c.avg_price > t THEN 4 WHEN nl < {bound} OR {depth} < 2 THEN 1
       WHEN c.n_orders <= 8 THEN 2 ELSE 3 END), 6) AS prob FROM complete c, m, b"""))
def q_derived_scores(spark, sf):
    """Scores of the whole tree and of trees cut out of it, from one descent (M2, M5)."""
    s, tree = _two_level(spark, sf)
    tree = cut_lineage(tree)
    nl = tree.where("node_id = 1").first()["cover"]
    cuts = [(1, 99 if depth is None else depth, int(nl) + 1 if "nl" in bound else int(bound)) for bound, depth in CUTS.values()]
    scored = nodes.score_candidates(s, tree, ["n_orders", "avg_price"], cuts)
    named = F.array(*[F.lit(n) for n in CUTS])
    return scored.select("key", F.posexplode("probs").alias("i", "p")).select(
        "key", F.element_at(named, F.col("i") + 1).alias("cut"), r6("p").alias("prob"))


# --------------------------------- what must hold of the model queries, row by row


@register("forest_prediction_checks", SUBJ + """
SELECT key, label, true AS is_probability, true AS class_follows, true AS decision_follows FROM subjects""")
def q_forest_prediction_checks(spark, sf):
    out = q_forest_predictions(spark, sf)
    decided = F.col("prob") >= D.DECISION_THRESHOLD
    return out.select("key", "label", F.col("prob").between(0, 1).alias("is_probability"),
                      (F.col("pred") == (F.col("prob") > 0.5).cast("int")).alias("class_follows"),
                      ((F.col("decision") == decided.cast("int"))
                       & (F.col("decision_label") == F.when(decided, "Risk").otherwise("No Risk"))).alias("decision_follows"))


@register("forest_cv_checks", SUBJ.rstrip() + "," + SCORED_SQL + """
SELECT fold, count(*) AS n, sum(label) AS positives, true AS metrics_follow FROM scored GROUP BY fold""")
def q_forest_cv_checks(spark, sf):
    out = q_forest_cv_metrics(spark, sf)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    near = lambda c, want: F.abs(F.col(c) - F.coalesce(want, F.lit(0.0))) < 1e-9
    ratio = lambda a, b: F.when(b > 0, a / b)
    follow = (near("Accuracy", (tp + tn) / F.col("n")) & near("Precision", ratio(tp, tp + fp)) & near("Recall", ratio(tp, tp + fn))
              & near("F1", ratio(2 * tp, 2 * tp + fp + fn)) & F.col("`ROC-AUC`").between(0, 1))
    return out.select("fold", "n", (F.col("tp") + F.col("fn")).cast("double").alias("positives"), follow.alias("metrics_follow"))


REGISTERED_GRID = {"n_estimators": [5, 10], "max_depth": [3, 5], "min_samples_split": [2, 60], "min_samples_leaf": [1, 20],
                   "max_features": ["sqrt"]}


@register("grid_search_checks", " UNION ALL ".join(
    f"SELECT {i} AS candidate, '{json.dumps(c)}' AS params, 5 AS folds, true AS recalls_follow"
    for i, c in enumerate(forest.expand_grid(REGISTERED_GRID))))
def q_grid_search_checks(spark, sf):
    """Every candidate of a grid with split bounds is scored on every fold, from two fits a fold (M2, M4)."""
    data = _prepared_with_folds(spark, sf)
    _, table = forest.grid_search(spark, data, FEATURES, "label", REGISTERED_GRID, "fold", parallelism=2)
    each = F.col("fold_recall")
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)
    follow = ((F.abs(mean - F.col("mean_recall")) < 1e-9) & F.forall(each, lambda r: r.between(0, 1))
              & F.col("mean_train_recall").between(0, 1) & (F.col("std_recall") >= 0) & (F.col("std_train_recall") >= 0))
    return table.select("candidate", "params", F.size(each).alias("folds"), follow.alias("recalls_follow"))


@register("feature_importance_checks", " UNION ALL ".join(
    f"SELECT {i} AS pos, '{f}' AS feature, true AS same_from_nodes" for i, f in enumerate(FEATURES)))
def q_feature_importance_checks(spark, sf):
    """Spark's importances are those worked out from the node table."""
    data = _prepared_with_folds(spark, sf)
    model = forest.fit_forest(data, FEATURES, "label", SMALL_FOREST)
    own = nodes.node_importances(nodes.forest_nodes(model), len(FEATURES)).select("pos", F.col("importance").alias("_own"))
    out = forest.feature_importance(spark, model, FEATURES, len(FEATURES)).join(own, "pos")
    return out.select("pos", "feature", (F.abs(F.col("importance") - F.col("_own")) < 1e-9).alias("same_from_nodes"))


@register("shap_checks", SUBJ + """
SELECT key, true AS adds_up, true AS in_parts, true AS reasons_are_largest, true AS prompt_names_reasons FROM subjects""")
def q_shap_checks(spark, sf):
    """Attributions add up, are the same from trees in groups, and reasons and prompts follow from them."""
    fitted, scaled, display = prepare(subjects(spark, sf), SUBJECT_SPEC)
    tree = forest.forest_nodes(forest.fit_forest(scaled, FEATURES, "label", SMALL_FOREST))
    shap = cut_lineage(explain.tree_shap(scaled, tree, FEATURES, "key"))
    parts = explain.tree_shap(scaled, tree, FEATURES, "key", group_bytes=40_000).select("key", F.col("shap").alias("_parts"))
    reasons = explain.top_reasons(shap, "key", FEATURES, 3)
    listed = report.reason_list(reasons, "key", D.SUBJECT_DISPLAY_NAMES, "_listed")
    got = reasons.groupBy("key").agg(F.sum("shap_value").alias("_top"), F.max("reason_rank").alias("_k"))
    sh = shap.withColumn("reasons", report.reasons_inline("shap", FEATURES, D.SUBJECT_DISPLAY_NAMES, 3))
    sh = metrics.decide(sh, "prediction", D.DECISION_THRESHOLD, labels=D.STATUS_LABELS)
    asked = report.prompts(sh.join(_subject_blocks(fitted, display).select("key", "feature_block"), "key")).select("key", "user_prompt")
    both = shap.join(parts, "key").join(got, "key", "left").join(listed, "key", "left").join(asked, "key")
    ordered = F.slice(F.reverse(F.array_sort(F.filter("shap", lambda v: v > 0))), 1, 3)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    return both.select(
        "key", (F.abs(F.col("base_value") + total(F.col("shap")) - F.col("prediction")) < 1e-9).alias("adds_up"),
        F.forall(F.zip_with("shap", "_parts", lambda a, b: F.abs(a - b)), lambda d: d < 1e-12).alias("in_parts"),
        ((F.abs(total(ordered) - F.coalesce("_top", F.lit(0.0))) < 1e-12)
         & (F.size(ordered) == F.coalesce("_k", F.lit(0)))).alias("reasons_are_largest"),
        F.col("user_prompt").contains(F.coalesce("_listed", F.lit(""))).alias("prompt_names_reasons"))
