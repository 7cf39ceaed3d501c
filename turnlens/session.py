"""A session with the settings the operators count on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def session(name: str = "turnlens", **more: str) -> SparkSession:
    """The session; ``more`` adds settings, with _ for the dots of their names."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where spark.checkpoint.dir is unset a temporary one is set, but only in a session without other machines."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="turnlens-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint of a frame in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
