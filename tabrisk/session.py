"""Session helpers.

Library code never builds its own session: every operator takes the caller's
DataFrames.  ``local_session`` exists for tests, the bench and the driver
entry only.  ``checkpoint_dir`` reads the cluster's shared folder from the
session and sets one only when the session has none (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabrisk")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The folder the caller set on the context, else the one the cluster names in
    ``spark.checkpoint.dir``.  Neither is ever replaced.  Only a local session
    (tests, bench) without one gets a scratch folder; on a cluster the lack of
    one is an error, because executors cannot see a folder of the driver.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()  # a folder of its own below the one that was set
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabrisk-ckpt-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after the expensive steps (kNN imputation, SMOTE) whose output is read
    by several later stages, so that a lost executor recomputes from the
    checkpoint and not from the whole plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Held:
    """What one operator keeps for itself and frees once what depends on it has
    been checkpointed: frames in memory (spilling to disk) and scratch tables."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []
        self._tables: list[tuple[SparkSession, str]] = []

    def cache(self, df: DataFrame) -> DataFrame:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._frames.append(out)
        return out

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written below the checkpoint folder and read back.

        For steps that build on each other: a persisted frame carries the plans of all
        frames below it, once for each time they are used, so plans (and what the
        driver keeps of them) double from step to step; a table is one scan of known size.
        """
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark)}/held-{uuid.uuid4().hex}"
        self._tables.append((spark, path))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for df in self._frames:
            df.unpersist(blocking=False)
        self._frames.clear()
        for spark, path in self._tables:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self._tables.clear()
