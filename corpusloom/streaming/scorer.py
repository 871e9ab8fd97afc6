"""Scoring a stream of documents with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append (doc_id, topic, p) of a streaming (doc_id, tokens) to Parquet.

    ``transform`` keeps no state, so the stream needs no watermark, and the file sink with its
    checkpoint writes every batch exactly once.
    """
    q = model.transform(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
