"""Transcript files: one document a file, named by its date.

A file holds header lines (URL:, Fecha:, Título:), a blank line and the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions.text import lines, strip

#: Fixed values of the format.
HEADERS = {"url": "URL:", "fecha": "Fecha:", "titulo": "Título:"}
TRUNCATED = "(CONTINÚA…)"
HEADER_LINES = 5
BODY_FROM = 3


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): all .txt files under a path, whole."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("file"), "value")


def header(value: Column, field: str, among: int = HEADER_LINES) -> Column:
    """A header field: of the first lines that start with its name the last one; empty if there is none."""
    name = HEADERS[field]
    held = F.filter(F.slice(lines(value), 1, among), lambda s: F.startswith(s, F.lit(name)))
    return F.coalesce(strip(F.substr(F.try_element_at(held, F.lit(-1)), F.lit(len(name) + 1))), F.lit(""))


def body(value: Column) -> Column:
    """The lines after the header, speaker labels and all."""
    return F.array_join(F.slice(lines(value), F.lit(BODY_FROM + 1), F.greatest(F.size(lines(value)) - BODY_FROM, F.lit(0))), "\n")


def documents(files: DataFrame) -> DataFrame:
    """(file, url, fecha, titulo, incompleto, body) of each file; absent header fields are empty strings."""
    v = F.col("value")
    return files.select("file", *[header(v, f).alias(f) for f in HEADERS], v.contains(TRUNCATED).alias("incompleto"), body(v).alias("body"))


def date_urls(files: DataFrame) -> DataFrame:
    """(fecha, url): from the first three lines of each file that has both; the last file of a date counts."""
    v = F.col("value")
    both = files.select("file", header(v, "url", 3).alias("url"), header(v, "fecha", 3).alias("fecha")).where("url <> '' AND fecha <> ''")
    return both.groupBy("fecha").agg(F.max_by("url", "file").alias("url"))


def latest(docs: DataFrame) -> DataFrame:
    """The document with the largest file name."""
    return docs.orderBy(F.desc("file")).limit(1)


def pending(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links whose date has no document, or only a truncated one."""
    return links.join(docs.where(~F.col("incompleto")).select("fecha").distinct(), "fecha", "left_anti")


def upsert(stored: DataFrame, fetched: DataFrame, least: int = 500) -> DataFrame:
    """Documents by date after a fetch.

    A fetched body shorter than ``least`` is ignored; a whole document replaces
    what is stored, a truncated one only fills a gap; of several fetches of one
    date the last by ``file`` counts.
    """
    good = fetched.where(F.length("body") >= least)
    ranked = stored.withColumn("_new", F.lit(0)).unionByName(good.withColumn("_new", F.lit(1)))
    # whole before truncated, then new before old; a truncated one never replaces
    order = F.struct((~F.col("incompleto")).cast("int").alias("a"), F.when(F.col("incompleto"), -F.col("_new")).otherwise(F.col("_new")).alias("b"), "file")
    names = [c for c in stored.columns if c != "fecha"]
    best = ranked.groupBy("fecha").agg(F.max_by(F.struct(*names), order).alias("d"))
    return best.select("fecha", "d.*").select(*stored.columns)


def write_by_date(docs: DataFrame, path: str) -> None:
    """Documents as Parquet, one folder a date; only the dates at hand are overwritten."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fecha").parquet(path)
