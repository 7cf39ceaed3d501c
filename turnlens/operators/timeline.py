"""Timelines of actors on a spine of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions.dates import period


def spine(dates: DataFrame, grain: str = "month") -> DataFrame:
    """(periodo): the periods that occur."""
    return dates.select(period(F.col("fecha"), grain).alias("periodo")).distinct()


def timeline(events: DataFrame, who: Column, grain: str = "month", metric: str = "turns") -> DataFrame:
    """(periodo, n) of the chosen actors' events on the spine of all, 0 where they have none.

    ``metric``: turns counts events, conferences counts distinct dates.
    """
    n = F.count("*") if metric == "turns" else F.count_distinct("fecha")
    own = events.where(who).groupBy(period(F.col("fecha"), grain).alias("periodo")).agg(n.alias("n"))
    return spine(events, grain).join(own, "periodo", "left").select("periodo", F.coalesce("n", F.lit(0)).alias("n"))


def timelines(events: DataFrame, grain: str = "month", metric: str = "turns") -> DataFrame:
    """(actor, periodo, n) of every actor on the spine of all periods, 0 where the actor has no events.

    An actor's counts become a map, of as many entries as there are periods, and
    the spine, one row with an array of them, goes to every task.
    """
    n = F.count("*") if metric == "turns" else F.count_distinct("fecha")
    counts = events.groupBy("actor", period(F.col("fecha"), grain).alias("periodo")).agg(n.alias("n"))
    own = counts.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("periodo", "n"))).alias("held"))
    every = events.agg(F.sort_array(F.collect_set(period(F.col("fecha"), grain))).alias("spine"))
    # one row
    rows = own.join(F.broadcast(every)).select("actor", "held", F.explode("spine").alias("periodo"))
    return rows.select("actor", "periodo", F.coalesce(F.try_element_at("held", F.col("periodo")), F.lit(0)).alias("n"))


def detail(events: DataFrame, who: Column, periodo: str, grain: str = "month") -> DataFrame:
    """(fecha, n, resumen) of the chosen actors' events in one period, newest first."""
    own = events.where(who).where(period(F.col("fecha"), grain) == periodo).groupBy("fecha").agg(F.count("*").alias("n"))
    label = F.concat_ws(" ", F.col("n").cast("string"), F.when(F.col("n") == 1, "intervención").otherwise("intervenciones"))
    return own.select("fecha", "n", label.alias("resumen")).orderBy(F.desc("fecha"))


def category_sizes(events: DataFrame) -> DataFrame:
    """(categoria, actores, eventos)."""
    return events.groupBy("categoria").agg(F.count_distinct("actor").alias("actores"), F.count("*").alias("eventos"))
