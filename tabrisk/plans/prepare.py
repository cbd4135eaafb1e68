"""Preparation plan: clean -> encode -> select by correlation -> kNN impute ->
z-score, with fitted state kept as small tables, and applying that state to
new rows (X10) before appending them to the twin tables.

Fits are the only actions (categories, correlations, column means, moments);
everything else is one lazy plan.  The imputed table is checkpointed into the
shared checkpoint folder because scaling, sampling and SMOTE all read it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.operators import clean, encode, impute, scale
from tabrisk.operators import select as fselect
from tabrisk.operators.reshape import append_rows
from tabrisk.session import Held, cut_lineage


@dataclass
class PrepSpec:
    key: str
    label: str
    categorical: list[str]
    scaled: list[str]
    impute_target: str
    feature_order: list[str]              # model features, in source order
    corr_threshold: float = 0.2
    k: int = 5
    corr_exclude: list[str] = field(default_factory=list)
    valid_filter: tuple[str, str] | None = None   # (column, rejected value)


@dataclass
class FittedPrep:
    spec: PrepSpec
    encoder: encode.OrdinalEncoding
    impute_cols: list[str]
    imputer: impute.KnnImputer
    scaler: scale.ZScore

    @property
    def features(self) -> list[str]:
        return list(self.spec.feature_order)

    def encode(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df)

    def apply(self, new_rows: DataFrame, on_unknown: str = "error") -> tuple[DataFrame, DataFrame]:
        """Raw new rows -> (scaled, display) with the fitted state."""
        display = self.display(new_rows, on_unknown)
        return self.scaler.transform(display), display

    def display(self, new_rows: DataFrame, on_unknown: str = "error") -> DataFrame:
        """Raw new rows encoded and imputed, on the original scale.

        A category that was not met in the fit is an error or, with ``on_unknown="null"``,
        has no code; the imputer leaves it so, because a mean of codes is no category.
        """
        enc = self.encoder.transform(new_rows, on_unknown)
        return self.imputer.transform(enc.withColumns({c: F.col(c).cast("double") for c in self.impute_cols}),
                                      keep=self.encoder.cols)

    def append(self, scaled: DataFrame, display: DataFrame, new_rows: DataFrame,
               dedup: bool = False, on_unknown: str = "error") -> tuple[DataFrame, DataFrame]:
        """Both twin tables with the prepared new rows appended by column name."""
        ns, nd = self.apply(new_rows, on_unknown)
        key = self.spec.key if dedup else None
        return append_rows(scaled, ns, key), append_rows(display, nd, key)

    # artifacts: small parquet tables + one JSON spec, in one directory
    def save(self, spark: SparkSession, path: str) -> None:
        self.encoder.table.write.mode("overwrite").parquet(f"{path}/encoder")
        self.scaler.table(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        self.imputer.donors.write.mode("overwrite").parquet(f"{path}/imputer_donors")
        meta = {"spec": asdict(self.spec), "impute_cols": self.impute_cols,
                "impute_means": self.imputer.means, "encoder_cols": self.encoder.cols}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPrep":
        meta = json.loads(spark.read.text(f"{path}/spec").first()[0])
        sp = meta["spec"]
        if sp.get("valid_filter"):
            sp["valid_filter"] = tuple(sp["valid_filter"])
        spec = PrepSpec(**sp)
        table = spark.read.parquet(f"{path}/encoder")
        enc = encode.OrdinalEncoding(meta["encoder_cols"], table)
        params = {r["feature"]: (r["mean"], r["std_pop"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
        scaler = scale.ZScore(spec.scaled, params)
        donors = spark.read.parquet(f"{path}/imputer_donors")
        imp = impute.KnnImputer(meta["impute_cols"], spec.key, spec.k, donors, meta["impute_means"])
        return FittedPrep(spec, enc, meta["impute_cols"], imp, scaler)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]


def prepare(df: DataFrame, spec: PrepSpec) -> tuple[FittedPrep, DataFrame, DataFrame]:
    """Fit and apply: returns (fitted state, scaled table, display table).

    The display table holds encoded categories and imputed numbers on their
    original scale; the scaled table differs only in ``spec.scaled`` columns.
    """
    if spec.valid_filter:
        col, reject = spec.valid_filter
        df = clean.filter_valid_category(df, col, reject)
    # the input is read by four fits (categories, correlations, means, kNN)
    held = Held()
    df = held.cache(df)
    enc_fit = encode.fit_ordinal(df, spec.categorical)
    enc = enc_fit.transform(df)
    candidates = [c for c in numeric_columns(enc) if c not in set(spec.corr_exclude)]
    # correlations and the imputer's column means in one pass
    selected, _, means = fselect.select_by_corr_with_means(enc, spec.impute_target, candidates,
                                                           spec.corr_threshold)
    enc = enc.withColumns({c: F.col(c).cast("double") for c in selected})
    imp = impute.fit_knn_imputer(enc, selected, spec.key, spec.k, means)
    display = imp.transform(enc)
    # scaling, sampling and SMOTE all read it; nothing depends on the persisted input any more
    display = cut_lineage(display)
    held.release()
    scaler = scale.fit_zscore(display, spec.scaled)
    scaled = scaler.transform(display)
    return FittedPrep(spec, enc_fit, selected, imp, scaler), scaled, display
