"""Fitted models on streams.

``transform`` of a fitted reducer and ``predict`` of a fitted learner are row-local, so they apply to a
streaming DataFrame as they are. There is no state and no watermark to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def narrow_stream(stream: DataFrame, *models) -> DataFrame:
    """Apply fitted models (anything with ``transform`` or ``predict``) one after the other."""
    for model in models:
        stream = model.predict(stream) if hasattr(model, "predict") else model.transform(stream)
    return stream


def write_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what has arrived, append it, remember the position in a shared ``checkpoint`` folder, stop."""
    return (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
