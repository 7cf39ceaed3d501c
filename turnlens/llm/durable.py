"""Cutting lineage so that results outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.session import checkpointed as checkpointed
from turnlens.session import shared_folder as shared_folder


def small(frame: DataFrame, most: int) -> DataFrame:
    """A checkpoint of a frame, to be broadcast if it has at most ``most`` rows; else AQE can split a hot key it is joined by."""
    kept = checkpointed(frame)
    return F.broadcast(kept) if kept.count() <= most else kept
