"""Incremental ingest of transcript files, with the dates taken so far as state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnlens import schemas
from turnlens.session import checkpointed
from turnlens.sources.corpus import documents, write_by_date

TAKEN, FAILED, PRESENT = "ok", "fallo", "presente"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Dates(StatefulProcessor):
    """What becomes of a date's files, in the order of their names: the state of a date says whether its document is whole.

    A whole document is never fetched again. Short bodies fail; a truncated one
    only fills a gap, and is tried again until a whole one comes.
    """

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", "whole boolean")

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer_values: object) -> None:
        self.whole.update((bool(initial["entero"].any()),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        # the files of one date in one batch
        batch = pd.concat(list(rows)).sort_values(["file", "url", "titulo", "body"])
        status = []
        for body, truncated in zip(batch["body"], batch["incompleto"], strict=True):
            seen = self.whole.get()[0] if self.whole.exists() else None
            if seen:
                status.append(PRESENT)
            elif len(body) < self.least or (truncated and seen is not None):
                status.append(FAILED)
            else:
                status.append(TAKEN)
                self.whole.update((not truncated,))
        yield batch.assign(status=status, orden=range(len(batch)))

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The provider that such state needs, and the caller's one back."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def outcomes(files: DataFrame, least: int, initial: DataFrame) -> DataFrame:
    """The documents of a stream of (file, value) with ``status``: ok, fallo or presente.

    ``initial`` has (fecha, entero) of the documents that are there when the stream
    first starts. Files without a date are left out.
    """
    new = documents(files).where("fecha <> ''")
    schema = f"{schemas.DOCUMENT}, status string, orden int"
    return new.groupBy("fecha").transformWithStateInPandas(Dates(least), schema, "Append", "none", initialState=initial.groupBy("fecha"))


def _initial(spark: SparkSession, documents_path: str, path: str) -> DataFrame:
    """(fecha, entero) of the documents there were when a stream first started, kept beside its checkpoint: a batch taken again must meet the same state."""
    schema = "fecha string, entero boolean"
    if not _exists(spark, f"{path}/_SUCCESS"):
        there = _exists(spark, documents_path)
        stored = spark.read.parquet(documents_path) if there else spark.createDataFrame([], "fecha string, incompleto boolean")
        stored.select(F.col("fecha").cast("string").alias("fecha"), (~F.col("incompleto")).alias("entero")).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ingest_stream(files: DataFrame, target: str, checkpoint: str, least: int = 500, on_batch: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """Take what is new in a stream of (file, value) into the documents ``target``/documentos, then stop; how many files were taken, failed and were present.

    A date is one document. A batch is written to the shared folder first, so that
    a lost executor changes nothing; it counts as done only once its dates, its
    part of the log ``target``/registro and ``on_batch``, for instance a notice to
    somebody, are done, else the next run takes it again, to the same result.
    """
    spark = files.sparkSession
    initial = _initial(spark, f"{target}/documentos", f"{checkpoint.rstrip('/')}-inicial")
    names = [f.split(" ")[0] for f in schemas.DOCUMENT.split(", ")]

    def take(batch: DataFrame, number: int) -> None:
        held = checkpointed(batch)
        last = held.where(F.col("status") == TAKEN).groupBy("fecha").agg(F.max_by(F.struct(*[n for n in names if n != "fecha"]), "orden").alias("d"))
        taken = last.select("fecha", "d.*").select(*names)
        write_by_date(taken, f"{target}/documentos")
        held.select("fecha", "file", "status").withColumn("lote", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(f"{target}/registro")
        if on_batch:
            on_batch(taken)

    found = outcomes(files, least, initial)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (TAKEN, FAILED, PRESENT)]
    with _state_store(spark):
        stream = found.observe("ingest", *counts).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
    total: Counter = Counter({TAKEN: 0, FAILED: 0, PRESENT: 0})
    for progress in query.recentProgress:
        row = progress.observedMetrics.get("ingest")
        total.update({} if row is None else row.asDict())
    return dict(total)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, least: int = 500, on_batch: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """Take the transcript files that are new in the folder ``source`` (see ingest_stream)."""
    found = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(source)
    return ingest_stream(found.select(F.col("_metadata.file_name").alias("file"), "value"), target, checkpoint, least, on_batch)
