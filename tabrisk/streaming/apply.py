"""Fitted preparation and scoring on Structured Streaming sources.

Encoding and z-scoring are per-row projections over small fitted parameter
maps, and a forest's ``transform`` is per-row too, so they apply to a
``readStream`` DataFrame unchanged (:func:`encode_and_scale_stream`,
:func:`score_stream`).  kNN imputation needs a ranking window, which streams
do not allow, so full preparation runs per micro-batch in ``foreachBatch``
(:func:`prepare_stream`): every micro-batch is prepared as a batch DataFrame
and appended to the twin tables as a batch directory claimed in the name of
(stream, micro-batch), so a replayed micro-batch overwrites its own output and
never another writer's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabrisk.operators.forest import predict
from tabrisk.plans.prepare import FittedPrep
from tabrisk.session import cut_lineage
from tabrisk.sources.io import append_with_backup


def encode_and_scale_stream(fitted: FittedPrep, stream: DataFrame) -> DataFrame:
    """Encoded and z-scored rows of a stream; imputer columns stay as they are."""
    enc = fitted.encoder.transform(stream)
    enc = enc.withColumns({c: F.col(c).cast("double") for c in fitted.impute_cols})
    return fitted.scaler.transform(enc)


def score_stream(stream: DataFrame, model: RandomForestClassificationModel,
                 features: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Class-1 probability (and a thresholded decision) for every streamed row."""
    out = predict(stream, model, features)
    if threshold is not None:
        out = out.withColumn("decision", (F.col("prob") >= F.lit(threshold)).cast("int"))
    return out


def prepare_stream(fitted: FittedPrep, stream: DataFrame, scaled_path: str, display_path: str,
                   checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Prepare every micro-batch with the fitted state and append it to both tables.

    The progress of the stream lives in ``checkpoint_location``, which must be on
    shared storage on a cluster; it also names the stream as a writer.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        display = cut_lineage(fitted.display(batch))  # imputed once, read twice
        writer = f"{checkpoint_location}#{batch_id}"
        append_with_backup(fitted.scaler.transform(display), scaled_path, writer=writer)
        append_with_backup(display, display_path, writer=writer)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
