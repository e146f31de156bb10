"""Scoring of a stream of subjects under a frozen model: stateless, so it appends and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hedra.operators.score import Frozen, score_batch


def score_stream(subjects: DataFrame, frozen: Frozen, path: str, checkpoint: str, key: str = "subject_id", once: bool = False) -> StreamingQuery:
    """Writes scored subjects as Parquet, each input file once also after a restart. once: what is there now, then end."""
    out = score_batch(subjects, frozen, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
