"""Wide/long reshaping and row append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str] | str, features: Sequence[str],
            feature_col: str = "feature", value_col: str = "value",
            with_position: bool = True) -> DataFrame:
    """Columns of each row into ``(ids..., feature, [feature_pos], value)`` rows.

    Values are cast to double so that mixed numeric columns share one type.
    ``feature_pos`` keeps the column order for later ordered joins of texts.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    features = list(features)
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    out = wide.unpivot(ids, features, feature_col, value_col)
    if with_position:
        names = F.array(*[F.lit(c) for c in features])
        out = out.withColumn(f"{feature_col}_pos",
                             (F.array_position(names, F.col(feature_col)) - 1).cast("int"))
    return out


def append_rows(base: DataFrame, new: DataFrame, dedup_key: str | None = None) -> DataFrame:
    """Append by column name; columns absent on one side become NULL.

    Without ``dedup_key`` appending twice appends twice (as a plain concat);
    with it, new rows whose key is already in ``base`` are dropped.
    """
    if dedup_key is not None:
        new = new.join(base.select(dedup_key), dedup_key, "left_anti")
    return base.unionByName(new, allowMissingColumns=True)
