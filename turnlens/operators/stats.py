"""Counts by date and month, voice shares and lexicon ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions.dates import period
from turnlens.functions.text import letter_tokens, word_count

TYPES = ["presidenta", "pregunta", "funcionario", "otro"]


def by_date(turns: DataFrame) -> DataFrame:
    """Words and turns of each date; every type that isn't named counts as otro."""
    known = F.col("tipo").isin("presidenta", "pregunta", "funcionario")
    words = word_count(F.col("texto"))
    return turns.groupBy("fecha").agg(
        F.sum(words).alias("total_words"),
        F.coalesce(F.sum(F.when(F.col("tipo") == "presidenta", words)), F.lit(0)).alias("presidenta_words"),
        F.count_if(F.col("tipo") == "presidenta").alias("presidenta_turns"),
        F.count_if(F.col("tipo") == "pregunta").alias("pregunta_turns"),
        F.count_if(F.col("tipo") == "funcionario").alias("funcionario_turns"),
        F.count_if(~known).alias("otro_turns"),
    )


def overview(stats: DataFrame) -> DataFrame:
    """One row: months, first and last date that isn't empty, dates and turns, from :func:`by_date`."""
    return stats.agg(
        F.array_join(F.sort_array(F.collect_set(period(F.col("fecha")))), ",").alias("meses"),
        F.min(F.nullif("fecha", F.lit(""))).alias("fecha_inicio"),
        F.max(F.nullif("fecha", F.lit(""))).alias("fecha_fin"),
        F.count("*").alias("total_conferencias"),
        F.sum("presidenta_turns").alias("total_turnos"),
    )


def by_type(turns: DataFrame) -> DataFrame:
    return turns.groupBy("tipo").agg(F.count("*").alias("n"))


def voice_share(turns: DataFrame) -> DataFrame:
    """(mes, tipo, pct): each type's share of a month's words, in percent; months without words are left out."""
    counts = turns.groupBy(period(F.col("fecha")).alias("mes"), "tipo").agg(F.sum(word_count(F.col("texto"))).alias("n"))
    total = F.sum("n").over(Window.partitionBy("mes"))
    return counts.withColumn("total", total).where("total > 0").select("mes", "tipo", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def voice_pivot(turns: DataFrame) -> DataFrame:
    """A column a type, 0 where a month lacks it."""
    return voice_share(turns).groupBy("mes").pivot("tipo", TYPES).agg(F.first("pct")).fillna(0.0, TYPES)


def framing(turns: DataFrame, frames: dict[str, list[str]] = vocab.FRAMES, scopes: dict[str, str] | None = None) -> DataFrame:
    """(scope, mes, frame, hits, total, por_mil): lexicon words for each thousand letter runs of a month.

    All scopes (name to a condition) come from one pass over the turns. Months
    without a token are left out; a frame without hits has 0.
    """
    scopes = scopes or {"presidenta": "tipo = 'presidenta'", "total": "true"}
    tokens = turns.withColumn("_t", letter_tokens(F.col("texto")))
    hits = [_count_in(terms).alias(frame) for frame, terms in frames.items()]
    held = F.array(*[F.when(F.expr(c), F.lit(s)) for s, c in scopes.items()])
    counted = tokens.select(period(F.col("fecha")).alias("mes"), F.size("_t").alias("_n"), *hits, held.alias("_s"))
    rows = counted.select("mes", "_n", *frames, F.explode(F.array_compact("_s")).alias("scope"))
    sums = rows.groupBy("scope", "mes").agg(F.sum("_n").alias("total"), *[F.sum(f).alias(f) for f in frames]).where("total > 0")
    long = sums.unpivot(["scope", "mes", "total"], list(frames), "frame", "hits")
    return long.select("scope", "mes", "frame", "hits", "total", F.round(F.col("hits") * 1000.0 / F.col("total"), 3).alias("por_mil"))


def _count_in(terms: list[str]):
    return F.size(F.filter("_t", lambda t: t.isin(terms)))


def framing_pivot(turns: DataFrame, frames: dict[str, list[str]] = vocab.FRAMES) -> DataFrame:
    """A column a frame; a month that a scope lacks has no row, a missing value stays null."""
    return framing(turns, frames).groupBy("scope", "mes").pivot("frame", list(frames)).agg(F.first("por_mil"))
