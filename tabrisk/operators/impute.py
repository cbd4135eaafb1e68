"""kNN imputation (distance-weighted, k = 5 by default).

For every column with a missing value in a row, the donors are the rows that
have that column; the ``k`` nearest by NaN-aware distance over all imputer
columns (computed on the original, not partly imputed, values) give the
value ``sum(v/d) / sum(1/d)``; if some of them are at distance 0, the plain
mean of those.  No donor at a defined distance -> the column mean.

Only rows with a missing value look for neighbours, and only columns with gaps
are searched for; complete rows pass through.  The donors are shuffled once for
each such column, to find identical vectors and to place them in the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.operators.knn import knn_join


@dataclass
class KnnImputer:
    cols: list[str]
    key: str
    k: int
    donors: DataFrame              # key + cols of the fitted table
    means: dict[str, float | None]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``df`` with its gaps filled; those of ``keep`` stay, such columns only serve the distances."""
        cols, key = self.cols, self.key
        any_missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        complete = df.where(~any_missing)
        incomplete = df.where(any_missing)
        filled = incomplete
        gaps = incomplete.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        for c in cols:
            if c in keep or not gaps[c]:
                continue
            receivers = incomplete.where(F.col(c).isNull()).select(key, *cols)
            givers = self.donors.where(F.col(c).isNotNull()).select(key, *cols)
            nn = knn_join(receivers, givers, cols, self.k, qkey=key, dkey=key, n_cols=len(cols))
            vals = nn.join(givers.select(F.col(key).alias("d_key"), F.col(c).alias("_v")), "d_key")
            zero = F.col("dist") == 0
            est = vals.groupBy("q_key").agg(
                F.count_if(zero).alias("_nz"),
                F.avg(F.when(zero, F.col("_v"))).alias("_zavg"),
                F.sum(F.when(~zero, F.col("_v") / F.col("dist"))).alias("_wv"),
                F.sum(F.when(~zero, 1.0 / F.col("dist"))).alias("_w"))
            est = est.select(F.col("q_key").alias(key), F.when(F.col("_nz") > 0, F.col("_zavg"))
                             .otherwise(F.col("_wv") / F.col("_w")).alias(f"_imp_{c}"))
            mean = self.means.get(c)
            filled = (filled.join(est, key, "left")
                      .withColumn(c, F.coalesce(F.col(c), F.col(f"_imp_{c}"),
                                                F.lit(mean).cast("double")))
                      .drop(f"_imp_{c}"))
        return complete.unionByName(filled.select(*df.columns))


def fit_knn_imputer(df: DataFrame, cols: Sequence[str], key: str, k: int = 5,
                    means: dict | None = None) -> KnnImputer:
    """``means`` (column means already computed by an earlier pass) saves the
    aggregation; columns it lacks are averaged here."""
    cols = list(cols)
    known = {c: means[c] for c in cols if means and c in means}
    todo = [c for c in cols if c not in known]
    if todo:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in todo]).first()
        known.update({c: row[c] for c in todo})
    donors = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return KnnImputer(cols, key, k, donors, known)


def knn_impute(df: DataFrame, cols: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Fit on ``df`` and impute ``df`` (every imputer column, not only the target)."""
    df = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return fit_knn_imputer(df, cols, key, k).transform(df)
