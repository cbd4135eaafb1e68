"""Ordinal encoder: sorted distinct strings -> codes 0..c-1 per column.

The fitted state is the table ``(feature, category, code)``, whatever its size;
it is joined (broadcast when AQE measures it small enough), never collected.
A stream is encoded the same way, as a stream-static join.
Codes are plain doubles without ML attribute metadata, so tree learners split
them by threshold like any number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.functions.text import str_or_nan
from tabrisk.operators.ranking import ROWS_PER_BUCKET, prefix_sums
from tabrisk.session import cut_lineage

@dataclass
class OrdinalEncoding:
    cols: list[str]
    table: DataFrame                      # feature, category, code

    def transform(self, df: DataFrame, on_unknown: str = "error") -> DataFrame:
        out = df
        for c in self.cols:
            codes = self.table.where(F.col("feature") == c).select(
                F.col("category").alias("_enc_cat"), F.col("code").cast("double").alias("_enc_code"))
            out = out.withColumn("_enc_raw", str_or_nan(c)).join(codes, F.col("_enc_raw") == F.col("_enc_cat"), "left")
            code = F.col("_enc_code")
            if on_unknown == "error":
                code = F.when(code.isNull(), F.raise_error(
                    F.concat(F.lit(f"unknown category in {c}: "), F.col("_enc_raw")))).otherwise(code)
            out = out.withColumn(c, code.cast("double")).drop("_enc_raw", "_enc_cat", "_enc_code")
        return out

    def decode(self, df: DataFrame, c: str, name: str) -> DataFrame:
        """Append the category of the code in ``c`` (its own text form where there is none)."""
        labels = self.table.where(F.col("feature") == c).select(
            F.col("code").alias("_dec_code"), F.col("category").alias("_dec_cat"))
        out = df.join(labels, F.col(c).try_cast("double").try_cast("int") == F.col("_dec_code"), "left")
        return out.withColumn(name, F.coalesce("_dec_cat", F.col(c).cast("string"))).drop("_dec_code", "_dec_cat")


def fit_ordinal(df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> OrdinalEncoding:
    """Codes are ranks of the distinct categories within their column, taken in range
    buckets: a column with very many categories is sorted by many tasks."""
    cols = list(cols)
    long = df.select([str_or_nan(c).alias(c) for c in cols]).unpivot(
        [], cols, "feature", "category").distinct()
    codes = prefix_sums(cut_lineage(long), ["feature"], ["category"], {"code": F.lit(1)}, rows_per_bucket)
    return OrdinalEncoding(cols, cut_lineage(codes.withColumn("code", F.col("code").cast("int"))))
