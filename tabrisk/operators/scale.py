"""Z-score with population standard deviation (zero std -> divide by 1)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ZScore:
    cols: list[str]
    params: dict[str, tuple[float, float]]  # feature -> (mean, scale)

    def table(self, spark) -> DataFrame:
        rows = [(c, self.params[c][0], self.params[c][1]) for c in self.cols]
        return spark.createDataFrame(rows, "feature string, mean double, std_pop double")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                               for c, (m, s) in self.params.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m)
                               for c, (m, s) in self.params.items()})


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> ZScore:
    """One aggregation for all columns; the result is 2 numbers per column."""
    cols = list(cols)
    row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"),
                                             F.stddev_pop(c).alias(f"{c}__s"))]).first()
    params = {}
    for c in cols:
        s = row[f"{c}__s"]
        params[c] = (row[f"{c}__m"], 1.0 if not s else s)
    return ZScore(cols, params)
