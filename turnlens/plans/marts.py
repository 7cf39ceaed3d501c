"""The marts of a corpus: everything the views need, written as Parquet or JSON lines."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens import schemas, vocab
from turnlens.functions import names
from turnlens.functions.dates import period
from turnlens.operators import actors, kwic, parsing, stats, terms, topics
from turnlens.sources import corpus


def load(spark: SparkSession, path: str, stored: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, turns) of a folder of transcripts; turns carry their document's date.

    With ``stored``, the two tables are kept there: read if they are there (with
    the schemas in use, so nothing is inferred), else made and written first.
    Remove the folder to have them made anew.
    """
    if stored:
        tables = {"documents": schemas.DOCUMENT, "turns": schemas.STORED_TURN}
        if not all(_there(spark, f"{stored}/{name}/_SUCCESS") for name in tables):
            write(dict(zip(tables, load(spark, path), strict=True)), stored)
        docs, turns = (spark.read.schema(schema).parquet(f"{stored}/{name}") for name, schema in tables.items())
        return docs, turns
    files = corpus.read_corpus(spark, path)
    docs = corpus.documents(files)
    turns = parsing.segment(files).join(docs.select("file", "fecha"), "file")
    return docs, turns.withColumn("conv_id", F.col("file"))


def digest(docs: DataFrame, turns: DataFrame, compat_squared: bool = False) -> DataFrame:
    """One row about the latest document: what it is, its distinctive terms and who took part.

    The names of the day's officials are no terms of it. Participants come by
    interventions, the most first, then by name. Without documents there is no row.
    """
    last = corpus.latest(docs)
    file = (last.first() or {"file": None})["file"]
    own = turns.where(F.col("file") == file)
    spoken = own.where(F.col("tipo").isin("funcionario", "otro")).select(F.explode(F.regexp_extract_all(F.lower("hablante"), F.lit("[a-záéíóúüñ]{3,}"), F.lit(0))).alias("w"))
    stops = vocab.digest_stops([r["w"] for r in spoken.distinct().collect()])
    found = terms.pick(terms.distinctive(docs, F.col("file") == file, "file", "body", stops))
    temas = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "termino"))), lambda s: s["termino"]).alias("temas"))
    who = actors.participants(own, compat_squared)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("intervenciones")).alias("k"), "nombre", "cargo", "categoria", "intervenciones")))
    who = who.agg(F.transform(ranked, lambda s: F.struct(s["nombre"].alias("nombre"), s["cargo"].alias("cargo"), s["categoria"].alias("categoria"), s["intervenciones"].alias("intervenciones"))).alias("participantes"))
    asked = actors.question_count(own)
    # each side is one row
    return last.select("fecha", "titulo", "url", "incompleto").join(asked).join(temas).join(who)


def marts(docs: DataFrame, turns: DataFrame, tagger: Callable | None = None) -> dict[str, DataFrame]:
    """Name to table. ``tagger`` is a plug-in that finds lemmas and parts of speech in place of the one that is there."""
    pres = kwic.corpus(turns)
    stops = vocab.lexical_stops()
    resolved = actors.resolve(turns)
    speakers = actors.ranking(resolved)
    out = {
        "corpus_stats": stats.by_date(turns),
        "word_freq_monthly": terms.top_lemmas(pres, period(F.col("fecha")), "texto", stops, tagger=tagger),
        "tfidf_monthly": terms.tfidf(pres, period(F.col("fecha")), F.col("fecha"), F.struct("file", "turno"), "texto", stops),
        "speakers": speakers,
        "actor_fechas": actors.actor_dates(turns, resolved, speakers).orderBy("nombre", "fecha"),
        "voice_share": stats.voice_share(turns),
        "framing": stats.framing(turns),
        "turns": turns.select("file", "fecha", "turno", "tipo", "hablante", "texto"),
        "corpus_presidenta": kwic.newest_first(pres).select("orden", "fecha", "turno", "texto").orderBy("orden"),
        "fecha_url": docs.where("url <> '' AND fecha <> ''").groupBy("fecha").agg(F.max_by("url", "file").alias("url")),
        "stopwords": turns.sparkSession.createDataFrame([(w,) for w in vocab.functional_stops()], "termino string"),
        "resumen_ultima": digest(docs, turns),
    }
    found = topics.fit(pres, stops)
    if found:
        by_date = topics.by_date(found[1], found[2])
        out |= {"topic_labels": topics.labels(found[0], found[1]), "topics_por_fecha": by_date, "topics_por_mes": topics.by_month(by_date)}
    return out


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def write(tables: dict[str, DataFrame], path: str, form: str = "parquet", obsolete: Iterable[str] = ()) -> None:
    """Each mart in a folder of its own, replaced whole; then folders named ``obsolete`` go, if they are there."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(form).save(f"{path}/{name}")
    for name in set(obsolete) - set(tables):
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
        found, system = _path(spark, f"{path}/{name}")
        if system.exists(found):
            system.delete(found, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """A file takes another's place; on a file system in which renaming is one step, so is this."""
    jvm = spark._jvm
    found, place = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(found.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(found), context.makeQualified(place), options)


def publish(tables: dict[str, DataFrame], path: str, form: str = "parquet", keep: int = 2) -> str:
    """All marts as one version, which readers see whole or not at all; the version's name.

    The tables are written to a folder of the version; only then a manifest that
    names it takes the place of the one before. A build that fails or is killed
    leaves the old version as it is. Of the versions before this one, ``keep`` - 1
    stay for readers that began with them, so what is no longer among the tables goes with its version.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.format(form).save(f"{path}/versions/{version}/{name}")
    found, system = _path(spark, f"{path}/manifest-{version}")
    out = system.create(found)
    out.write(bytearray(f"{version} {form}\n".encode()))
    out.close()
    _rename(spark, f"{path}/manifest-{version}", f"{path}/MANIFEST")
    folder, system = _path(spark, f"{path}/versions")
    # unfinished versions that are older go as well
    older = sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName() < version)
    for name in older[: max(len(older) - keep + 1, 0)]:
        system.delete(_path(spark, f"{path}/versions/{name}")[0], True)
    return version


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The marts of the version that the manifest names, by name; none if nothing was published."""
    if not _there(spark, f"{path}/MANIFEST"):
        return {}
    version, form = spark.read.text(f"{path}/MANIFEST").first()[0].split(" ")
    folder, system = _path(spark, f"{path}/versions/{version}")
    names = sorted(s.getPath().getName() for s in system.listStatus(folder))
    return {name: spark.read.format(form).load(f"{path}/versions/{version}/{name}") for name in names}


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(tabla, bytes) of each mart that has been written."""
    found, system = _path(spark, path)
    folders = [s.getPath() for s in system.listStatus(found) if s.isDirectory()]
    return spark.createDataFrame([(f.getName(), system.getContentSummary(f).getLength()) for f in folders], "tabla string, bytes bigint")


def outcome(log: DataFrame) -> DataFrame:
    """(status, n) of an ingest log."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def categories(resolved: DataFrame) -> DataFrame:
    """(categoria, actores) of resolved officials."""
    return resolved.select("nombre").distinct().groupBy(names.category(F.col("nombre")).alias("categoria")).agg(F.count("*").alias("actores"))
