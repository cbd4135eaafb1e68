"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.session import checkpoint_dir

#: ASCII white space, the only separator the contracts name.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names: a lost
    executor recomputes from there, and several jobs read it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(id_col: str, mod: int) -> Column:
    """``crc32(id as text) mod m``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int,
                    most_bytes: int) -> DataFrame:
    """``_y, _key, _text`` of at most ``each`` documents a label, one row each.

    Identifiers and labels are joined and drawn first, in the order of a hash of
    the identifier; the drawn keys (a proven bound) are broadcast to one scan of
    the texts, so no text but the sample's is moved.  Longer texts are not drawn;
    of several texts under one identifier the smallest is taken.
    """
    short = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= most_bytes
    keys = docs.where(short).select(F.col(id_col).alias("_key")).join(
        labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).alias("_y")), "_key")
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_key"), "_key")
    drawn = keys.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("_key", "_y")
    texts = docs.where(short).select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(drawn), "_key").groupBy("_y", "_key").agg(F.min("_text").alias("_text"))
