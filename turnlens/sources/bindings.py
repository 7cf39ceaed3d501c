"""The synthetic tables seen as a transcript corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions.text import strings

#: Labels dealt to the officials' turns.
LABELS = [
    "SECRETARIO DE SALUD, DAVID PAZ", "DAVID PAZ, SECRETARIO DE SALUD", "SECRETARIO DE SALUD, DAVID PAZ (ENLACE VIDEOLLAMADA)",
    "GOBERNADORA DE BAJA CALIFORNIA SUR, ANA RUIZ", "GOBERNADORA DE BAJA CALIFORNIA SUR, ANA MARÍA RUIZ", "DIRECTOR GENERAL DE PUERTOS, JUAN LARA",
    "JEFA DE GOBIERNO, CLARA BRUGADA MOLINA", "SECRETARIO GENERAL DEL SINDICATO, JUAN HIDALGO", "TITULAR DE LA OFICINA DE DATOS, EDUARDO CLARK DOBARGANES",
    "TITULAR DE LA OFICINA DE DATOS, EDUARDO CLARK GARCÍA DOBARGANES", "SECRETARIO DE SALUD", "COORDINADORA NACIONAL, NOEMÍ JUÁREZ PÉREZ",
    "COORDINADORA NACIONAL, ANGÉLICA NOEMÍ JUÁREZ PÉREZ",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, fecha, turno, tipo, hablante, texto) from conversations."""
    day = F.date_add(F.lit("2024-10-02").cast("date"), ((F.col("conv_id") * 7) % 365).cast("int"))
    tipo = F.when(F.col("role") == "assistant", "presidenta").when(F.col("role") == "user", "pregunta").when(F.col("role") == "system", "funcionario")
    label = F.get(strings(LABELS), ((F.col("conv_id") * 5 + F.col("turn")) % len(LABELS)).cast("int"))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", day.cast("string").alias("fecha"), F.col("turn").alias("turno"), tipo.alias("tipo"), label.alias("hablante"), F.col("text").alias("texto")
    ).withColumn("tipo", F.coalesce("tipo", F.lit("otro")))


def official_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all but the first type, as officials'."""
    return turns(spark, sf_dir).where("tipo <> 'presidenta'").withColumn("tipo", F.lit("funcionario"))


def actor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor, fecha, categoria) from events, one row a turn."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("actor"), F.to_date("ts").cast("string").alias("fecha"), F.col("event_type").alias("categoria")
    )


def labelled(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    """(conv_id, fecha, turno, label, texto): the turns with one of some labels dealt to each."""
    label = F.get(strings(labels), ((F.col("conv_id") * 5 + F.col("turno")) % len(labels)).cast("int"))
    return turns(spark, sf_dir).select("conv_id", "fecha", "turno", label.alias("label"), "texto")


def transcripts(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    """(file, value): each conversation as a transcript file; every fifth one is cut off, every seventh ends before its last turns."""
    said = F.concat_ws(": ", "label", "texto")
    ended = F.when((F.col("conv_id") % 7 == 0) & (F.col("turno") == 2), F.concat(F.lit("—000—\n"), said)).otherwise(said)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turno", ended.alias("s")))), lambda x: x["s"])
    whole = labelled(spark, sf_dir, labels).groupBy("conv_id", "fecha").agg(F.array_join(lines, "\n").alias("body"))
    head = F.concat(
        F.lit("URL: https://example.org/a/"), F.col("conv_id"), F.lit("\nFecha: "), F.col("fecha"), F.lit("\nTítulo: Conversación "), F.col("conv_id"), F.lit("\n\n")
    )
    cut = F.when(F.col("conv_id") % 5 == 0, F.lit("\n(CONTINÚA…)")).otherwise(F.lit(""))
    return whole.select(F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit(".txt")).alias("file"), F.concat(head, F.col("body"), cut).alias("value"))


def archive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, href): links of an archive, one for each turn, of five forms."""
    day = F.col("fecha").cast("date")
    month = F.get(strings(vocab.MONTHS), F.month(day) - 1)
    date = lambda m: F.concat(F.lit("del-"), F.dayofmonth(day), F.lit("-de-"), m, F.lit("-de-"), F.year(day))
    press, other = F.lit("version-estenografica-conferencia-de-prensa-"), F.lit("version-estenografica-toma-de-protesta-")
    form = F.col("conv_id") % 5
    href = (
        F.when(form == 0, F.concat(F.lit("/articulos/"), other, date(month)))
        .when(form == 1, F.concat(F.lit("https://example.org/articulos/"), press, date(month)))
        .when(form == 2, F.concat(F.lit("/articulos/"), press, date(F.lit("foo"))))
        .when(form == 3, F.concat(F.lit("/articulos/"), press, date(month), F.lit("?x=1")))
        .otherwise(F.concat(F.lit("/articulos/otra-cosa-"), date(month)))
    )
    # set apart by a generator, or every use of the link would compute it anew
    return turns(spark, sf_dir).select(F.col("conv_id").alias("page_id"), F.col("turno").alias("pos"), F.explode(F.array(href)).alias("href"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, url, fecha, titulo, incompleto, body): the documents as fetches of dates; every third one is truncated."""
    day = F.date_add(F.lit("2024-10-02").cast("date"), (F.col("doc_id") % 500).cast("int")).cast("string")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("file"),
        F.concat(F.lit("https://example.org/d/"), F.col("doc_id")).alias("url"),
        day.alias("fecha"),
        F.col("lang").alias("titulo"),
        (F.col("doc_id") % 3 == 0).alias("incompleto"),
        F.col("text").alias("body"),
    )


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive, page, status, html): ten conversations as an archive, a turn as a listing page; each of the rules of a scan stops some archive."""
    rows = read(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 10").alias("archive"), (F.col("conv_id") % 10 * 8 + F.col("turn") + 1).alias("page"), F.col("conv_id"), F.col("turn")
    )
    kind, page = F.col("archive") % 4, F.col("page")
    silent = ((kind == 1) & page.between(17, 30)) | (page % 13 == 5)
    step = F.when(kind == 0, 12).when(kind == 2, 5).otherwise(3)
    latest = F.date_sub(F.lit("2026-06-01").cast("date"), (page * step).cast("int"))
    n = F.when((kind == 2) & (page > 45), 0).otherwise(1 + page % 3).cast("int")
    months = strings(vocab.MONTHS)

    def article(i):
        day = F.date_sub(latest, i)
        slug = F.when((kind == 3) & (page > 60), "otra-cosa").when((page + i) % 5 == 4, "version-estenografica-toma-de-protesta").otherwise("version-estenografica-conferencia-de-prensa")
        date = F.concat(F.lit("-del-"), F.dayofmonth(day), F.lit("-de-"), F.get(months, F.month(day) - 1), F.lit("-de-"), F.year(day))
        site = F.when((page + i) % 2 == 0, "https://example.org").otherwise("")
        return F.concat(F.lit('<article class="post">\n<h2>x</h2><a class="small" href="'), site, F.lit("/articulos/"), slug, date, F.lit('">Continuar leyendo</a></article>'))

    inner = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), article), "\n")).otherwise("")
    outside = '<nav><a href="/articulos/version-estenografica-otra-del-1-de-enero-de-2020">x</a></nav>'
    html = F.concat(F.lit(f"<html><body>{outside}"), inner, F.lit("</body></html>"))
    return rows.select("archive", "page", F.when(silent, "timeout").otherwise("ok").alias("status"), F.when(~silent, html).alias("html"))


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): the pages, two of three with a date among their metadata, in one of two forms."""
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta name="date" content="'), day, F.lit('">'))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00Z">'))
    )
    head = F.concat(F.lit("<head>"), F.coalesce(meta, F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("<head>"), head).alias("html"))


def dropped(spark: SparkSession, sf_dir: str, labels: list[str]) -> list[DataFrame]:
    """Three drops of (file, value): all transcripts, every second one again and whole, and all again."""
    files = transcripts(spark, sf_dir, labels)
    named = lambda prefix: F.concat(F.lit(prefix), F.col("file"))
    whole = F.replace("value", F.lit("(CONTINÚA…)"), F.lit(""))
    second = files.where(F.substring("file", 1, 12).cast("long") % 2 == 0)
    return [files, second.select(named("b-").alias("file"), whole.alias("value")), files.select(named("c-").alias("file"), "value")]
