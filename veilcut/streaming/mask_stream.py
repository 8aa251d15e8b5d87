"""Masking of a stream: digests are pure, so no state is kept; micro-batches are written once each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.generators import Limits
from ..operators.masking import transform


def mask_stream(stream: DataFrame, key: bytes, plan: dict[str, tuple[str, Limits]]) -> DataFrame:
    """The stream with its planned columns masked; equal values mask as in batch tables."""
    return transform(stream, key, plan)


def write_stream(stream: DataFrame, target: str, checkpoint: str):
    """Start a query that appends to Parquet; its checkpoint gives each file exactly once.  Takes what is there, then ends."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
