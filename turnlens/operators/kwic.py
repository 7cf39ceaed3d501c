"""Keyword in context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions import text as T
from turnlens.functions.dates import period

WINDOW = 120
PAGE = 15


def query(term: str) -> str:
    """The term to search for; raises ValueError with what is wrong with it."""
    term = term.strip().lower()
    if not term:
        raise ValueError("an empty query")
    if not any(c.isspace() for c in term) and len(term) < 3:
        raise ValueError("a single word needs three letters")
    if term in vocab.functional_stops():
        raise ValueError("a functional word is not indexed")
    return term


def corpus(turns: DataFrame, tipo: str = "presidenta") -> DataFrame:
    """The turns of one type."""
    return turns.where(F.col("tipo") == tipo)


def newest_first(turns: DataFrame) -> DataFrame:
    """All columns with ``orden``, from 0: newest date first, within a date in the order of documents and turns.

    Readers of a written table don't keep the order of its rows, so it is a
    column: the rank within the date behind the turns of all later dates. The
    only window over everything is that over the dates.
    """
    dates = turns.groupBy("fecha").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc("fecha"))) - F.col("_n")
    placed = turns.join(F.broadcast(dates.select("fecha", before.alias("_before"))), "fecha")
    within = F.row_number().over(Window.partitionBy("fecha").orderBy("conv_id", "turno"))
    return placed.withColumn("orden", F.col("_before") + within - 1).drop("_before")


def hits(turns: DataFrame, term: str, around: int = WINDOW) -> DataFrame:
    """All columns of ``turns`` with ``at`` (from 0) and ``ctx`` of each whole-word match. A cheap search for the string goes first."""
    found = turns.where(F.contains(F.lower("texto"), F.lit(term))).select("*", F.explode(T.offsets(F.col("texto"), term)).alias("at"))
    return found.withColumn("ctx", T.context(F.col("texto"), F.col("at"), len(term), around))


def linked(found: DataFrame, date_urls: DataFrame, term: str) -> DataFrame:
    """Hits with ``frase`` and ``link``, null where the date has no URL."""
    out = found.join(date_urls, "fecha", "left").withColumn("frase", T.sentence(F.col("texto"), F.col("at"), len(term)))
    return out.withColumn("link", T.fragment_link(F.col("url"), F.col("frase")))


def page(found: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One page of hits, newest first; a page of results is the feature."""
    return found.orderBy(F.desc("fecha"), "conv_id", "turno", "at").offset(number * size).limit(size)


_ORDER = ("conv_id", "turno", "at")


def store_pages(found: DataFrame, path: str, parts: int = 64) -> None:
    """Hits in the order of pages, in a folder for each range of them, so that a page reads its own ranges only."""
    rows = found.repartitionByRange(parts, F.desc("fecha"), *_ORDER).sortWithinPartitions(F.desc("fecha"), *_ORDER)
    rows.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(path)


def stored_page(spark: SparkSession, path: str, number: int, size: int = PAGE) -> DataFrame:
    """One page of stored hits, as page gives it: the ranges' sizes say in which of them it lies, and the others are not read."""
    stored = spark.read.parquet(path)
    first, before, chosen, skip = number * size, 0, [], 0
    # a row for each range, from the files' footers
    for r in stored.groupBy("part").count().orderBy("part").collect():
        if before < first + size and before + r["count"] > first:
            if not chosen:
                skip = first - before
            chosen.append(r["part"])
        before += r["count"]
    return stored.where(F.col("part").isin(chosen)).drop("part").orderBy(F.desc("fecha"), *_ORDER).offset(max(skip, 0)).limit(size)


def trend(turns: DataFrame, term: str) -> DataFrame:
    """(mes, n): matches by month on the spine of all months, 0 included."""
    own = turns.where(F.contains(F.lower("texto"), F.lit(term)))
    own = own.groupBy(period(F.col("fecha")).alias("mes")).agg(F.sum(F.regexp_count(F.lower("texto"), F.lit(T.whole_word(term)))).alias("n"))
    months = turns.select(period(F.col("fecha")).alias("mes")).distinct()
    return months.join(own, "mes", "left").select("mes", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
