"""Queries by name. Each is a function of (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions import dates, names
from turnlens.functions import text as T
from turnlens.operators import actors, index, kwic, parsing, stats, terms, timeline, topics
from turnlens.plans import fixtures, oracle
from turnlens.session import shared_folder
from turnlens.sources import bindings as B
from turnlens.sources import archive, corpus, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Frequent words of the synthetic texts, which the real lexicons rarely hit.
TEST_FRAMES = {"articulos": ["the", "los", "las", "die", "les"], "enlaces": ["and", "que", "und", "of"], "crisis": vocab.FRAMES["crisis"]}
TERM, PHRASE = "the", "of the"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- statistics ---------------------------------------------------------------


@query
def corpus_stats_by_date(spark, d):
    return stats.by_date(B.turns(spark, d))


@query
def corpus_overview(spark, d):
    return stats.overview(stats.by_date(B.turns(spark, d)))


@query
def turns_by_type(spark, d):
    return stats.by_type(B.turns(spark, d))


@query
def voice_share_monthly(spark, d):
    return stats.voice_share(B.turns(spark, d))


@query
def voice_share_pivot(spark, d):
    return stats.voice_pivot(B.turns(spark, d))


@query
def framing_monthly(spark, d):
    return stats.framing(B.turns(spark, d), TEST_FRAMES)


@query
def framing_lexicons(spark, d):
    return stats.framing(B.turns(spark, d))


@query
def framing_pivot(spark, d):
    return stats.framing_pivot(B.turns(spark, d), TEST_FRAMES)


# --- terms --------------------------------------------------------------------


@query
def term_freq_topk(spark, d):
    return terms.top_terms(B.turns(spark, d).where("tipo = 'presidenta'"), dates.period(F.col("fecha")), "texto", vocab.lexical_stops())


@query
def tagged_words(spark, d):
    return terms.tagged_words(B.turns(spark, d), ["conv_id", "turno"], "texto")


@query
def term_freq_lemmas(spark, d):
    return terms.top_lemmas(B.turns(spark, d), F.col("tipo"), "texto", vocab.lexical_stops())


@query
def word_freq_monthly(spark, d):
    return terms.top_lemmas(B.turns(spark, d).where("tipo = 'presidenta'"), dates.period(F.col("fecha")), "texto", vocab.lexical_stops())


@query
def term_freq_by_source(spark, d):
    return terms.top_terms(B.read(spark, d, "documents"), F.col("source"), "text", vocab.lexical_stops())


@query
def tfidf_topk(spark, d):
    turns = B.turns(spark, d).where("tipo = 'presidenta'")
    return terms.tfidf(turns, *terms.monthly(turns), "texto", vocab.lexical_stops())


def _digest(spark, d):
    # the longest document stands for the latest
    docs = B.read(spark, d, "documents")
    last = docs.agg(F.max_by("doc_id", F.struct("n_chars", "doc_id"))).first()[0]
    return terms.distinctive(docs, F.col("doc_id") == last, "doc_id", "text", vocab.digest_stops())


@query
def digest_terms(spark, d):
    return _digest(spark, d)


@query
def digest_pick(spark, d):
    return terms.pick(_digest(spark, d))


@query
def token_counts(spark, d):
    t = F.col("text")
    return B.read(spark, d, "documents").select(
        "doc_id",
        T.word_count(t).alias("n_words"),
        F.size(T.letter_tokens(t)).cast("long").alias("n_letters"),
        F.size(T.letter_tokens(t, 3)).cast("long").alias("n_letters3"),
        F.size(T.bigrams(T.letter_tokens(t, 3))).cast("long").alias("n_bigrams"),
    )


# --- concordance --------------------------------------------------------------


@query
def kwic_trend(spark, d):
    return kwic.trend(kwic.corpus(B.turns(spark, d)), kwic.query(TERM))


@query
def kwic_context(spark, d):
    return kwic.hits(kwic.corpus(B.turns(spark, d)), TERM).select("conv_id", "fecha", "turno", "at", "ctx")


def _date_urls(turns: DataFrame) -> DataFrame:
    # every third day has no page
    days = turns.select("fecha").distinct().where("day(fecha) % 3 <> 0")
    return days.withColumn("url", F.concat(F.lit("https://example.org/a/"), "fecha"))


@query
def kwic_links(spark, d):
    turns = kwic.corpus(B.turns(spark, d))
    found = kwic.linked(kwic.hits(turns, TERM), _date_urls(turns), TERM)
    return found.select("conv_id", "turno", "at", "frase", "link")


def _indexed(spark, d, term):
    turns = kwic.corpus(B.turns(spark, d))
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index.write(turns, ["conv_id", "turno"], path)
    return index.search(spark.read.parquet(path), turns, ["conv_id", "turno"], term).select("conv_id", "fecha", "turno", "at", "ctx")


@query
def kwic_indexed(spark, d):
    return _indexed(spark, d, TERM)


@query
def kwic_indexed_phrase(spark, d):
    return _indexed(spark, d, PHRASE)


@query
def kwic_page(spark, d):
    return kwic.page(kwic.hits(kwic.corpus(B.turns(spark, d)), TERM), 1).select("conv_id", "fecha", "turno", "at", "ctx")


@query
def kwic_stored_page(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    kwic.store_pages(kwic.hits(kwic.corpus(B.turns(spark, d)), TERM), path)
    return kwic.stored_page(spark, path, 1).select("conv_id", "fecha", "turno", "at", "ctx")


@query
def kwic_highlight(spark, d):
    found = kwic.hits(kwic.corpus(B.turns(spark, d)), TERM)
    return found.select("conv_id", "turno", "at", T.highlight(F.col("ctx"), TERM).alias("marked"))


# --- actors -------------------------------------------------------------------


@query
def participants(spark, d):
    return actors.participants(B.official_turns(spark, d))


@query
def participants_compat(spark, d):
    return actors.participants(B.official_turns(spark, d), compat_squared=True)


@query
def question_count(spark, d):
    return actors.question_count(B.turns(spark, d))


@query
def actor_timeline_month(spark, d):
    return timeline.timelines(B.actor_events(spark, d))


@query
def actor_timeline_day(spark, d):
    return timeline.timeline(B.actor_events(spark, d), F.lit(True), "day")


@query
def actor_timeline_conferences(spark, d):
    return timeline.timelines(B.actor_events(spark, d), "year", "conferences")


@query
def actor_period_detail(spark, d):
    return timeline.detail(B.actor_events(spark, d), F.lit(True), "2024", "year")


@query
def category_aggregate(spark, d):
    return timeline.category_sizes(B.actor_events(spark, d))


@query
def category_timeline(spark, d):
    events = B.actor_events(spark, d)
    return events.groupBy("categoria", dates.period(F.col("fecha"), "day").alias("periodo")).agg(
        F.count("*").alias("n"), F.count_distinct("actor").alias("actores")
    )


def _labels(spark, d):
    return B.labelled(spark, d, fixtures.LABELS)


@query
def speaker_classify(spark, d):
    return _labels(spark, d).select("conv_id", "turno", "label", names.speaker_type(F.col("label")).alias("tipo"), names.category(F.col("label")).alias("categoria"))


@query
def name_split(spark, d):
    x = names.normal_label(F.col("label"))
    role, name = names.display_name(F.col("label"))
    return _labels(spark, d).select(
        "conv_id", "turno", "label", names.name_segment(x).alias("nombre"), names.role_segment(x).alias("cargo"), role.alias("cargo_vista"), name.alias("nombre_vista")
    )


@query
def merge_key(spark, d):
    x = names.normal_label(F.col("label"))
    return _labels(spark, d).select("conv_id", "turno", "label", names.state(x).alias("estado"), names.person_key(x).alias("persona"), names.merge_key(x).alias("clave"))


@query
def entity_groups(spark, d):
    found = actors.groups(actors.variants(B.official_turns(spark, d)))
    return actors.connected(found, actors.containment_edges(found))


@query
def office_match(spark, d):
    return actors.office_match(actors.groups(actors.variants(B.official_turns(spark, d))))


@query
def officials_ranking(spark, d):
    return actors.ranking(actors.resolve(B.official_turns(spark, d)))


@query
def official_dates(spark, d):
    turns = B.official_turns(spark, d)
    return actors.actor_dates(turns, actors.resolve(turns)).groupBy("nombre").agg(F.count("*").alias("turnos"), F.count_distinct("fecha").alias("fechas"))


# --- documents and pages ------------------------------------------------------


def _transcripts(spark, d):
    return B.transcripts(spark, d, fixtures.LABELS)


@query
def turn_segmentation(spark, d):
    return parsing.segment(_transcripts(spark, d))


@query
def document_header(spark, d):
    return corpus.documents(_transcripts(spark, d)).select("file", "url", "fecha", "titulo", "incompleto", "body")


@query
def date_url_map(spark, d):
    return corpus.date_urls(_transcripts(spark, d))


@query
def latest_document(spark, d):
    return corpus.latest(corpus.documents(_transcripts(spark, d))).select("file", "fecha", "titulo")


@query
def paragraph_clean(spark, d):
    out = B.read(spark, d, "documents").select("doc_id", T.clean_paragraphs(F.col("text")).alias("texto"))
    return out.where(F.length("texto") >= 500)


@query
def page_links(spark, d):
    return pages.links(B.read(spark, d, "pages"))


@query
def url_dedup(spark, d):
    return pages.first_of_each(pages.links(B.read(spark, d, "pages")))


@query
def page_title_text(spark, d):
    out = pages.extract_documents(B.read(spark, d, "pages").select("page_id", "html"))
    return out.select("page_id", "titulo", "fecha_meta", "texto")


@query
def page_meta_date(spark, d):
    return pages.extract_documents(B.dated_pages(spark, d)).select("page_id", "fecha_meta")


@query
def page_url_list(spark, d):
    return B.archive_pages(spark, d).select("archive", "page", archive.page_url(F.col("page"), "https://example.org").alias("url"))


@query
def archive_scan(spark, d):
    return archive.scan(B.archive_pages(spark, d), "https://example.org").withColumn("fecha", F.col("fecha").cast("string"))


@query
def archive_stops(spark, d):
    return archive.stops(B.archive_pages(spark, d), "https://example.org")


@query
def date_from_slug(spark, d):
    u = F.col("url")
    slugs = B.archive_links(spark, d).select("page_id", "pos", F.col("href").alias("url"))
    return slugs.select("page_id", "pos", "url", dates.slug_date_text(u).alias("texto"), dates.slug_date(u).cast("string").alias("fecha"))


@query
def archive_articles(spark, d):
    return pages.article_links(B.archive_links(spark, d), "https://example.org").withColumn("fecha", F.col("fecha").cast("string"))


@query
def archive_latest(spark, d):
    return pages.latest_article(B.archive_links(spark, d), "https://example.org")


@query
def pending_fetch(spark, d):
    links = B.actor_events(spark, d).select("fecha").distinct().withColumn("url", F.concat(F.lit("u/"), "fecha"))
    docs = links.where("day(fecha) % 2 = 0").select("fecha", (F.dayofmonth(F.col("fecha").cast("date")) % 4 == 0).alias("incompleto"))
    return corpus.pending(links, docs)


@query
def document_upsert(spark, d):
    old, new = corpus.documents(_transcripts(spark, d)), B.fetched(spark, d)
    return corpus.upsert(old, new).select("fecha", "file", "incompleto", "titulo", "body")


@query
def period_labels(spark, d):
    day = F.col("fecha")
    return B.turns(spark, d).select("fecha").distinct().select(
        "fecha", dates.month_label(dates.period(day)).alias("mes"), dates.long_date(day).alias("largo"), dates.period(day, "year").alias("anio")
    )


# --- topics and streaming -----------------------------------------------------


def _topics(spark, d):
    return topics.fit(B.turns(spark, d).where("tipo = 'presidenta'"), vocab.lexical_stops())


@query
def lda_topics(spark, d):
    found = _topics(spark, d)
    if found is None:
        return _literal(spark, [], "topico int, rank int, termino string")
    return topics.labels(found[0], found[1])


@query
def topic_share_date(spark, d):
    found = _topics(spark, d)
    return _literal(spark, [], "fecha string, topico int, peso double") if found is None else topics.by_date(found[1], found[2])


@query
def topic_share_month(spark, d):
    found = _topics(spark, d)
    return _literal(spark, [], "mes string, t0 int") if found is None else topics.percent_pivot(topics.by_month(topics.by_date(found[1], found[2])))


def _given_topics(spark, d):
    return topics.means(topics.infer(B.turns(spark, d).where("tipo = 'presidenta'"), *topics.matrix(TEST_FRAMES)))


@query
def given_topic_share_date(spark, d):
    return _given_topics(spark, d)


@query
def given_topic_share_month(spark, d):
    return topics.percent_pivot(topics.by_month(_given_topics(spark, d)), len(TEST_FRAMES))


@query
def incremental_ingest(spark, d):
    # three drops, each taken by a run of its own
    from turnlens.streaming.ingest import ingest_stream

    base = f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    for files in B.dropped(spark, d, fixtures.LABELS):
        files.write.mode("append").parquet(f"{base}/in")
        ingest_stream(spark.readStream.schema("file string, value string").parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    stored = spark.read.parquet(f"{base}/out/documentos").select("file", "titulo", "incompleto")
    return spark.read.parquet(f"{base}/out/registro").select("fecha", "file", "status").join(stored, "file", "left")


@query
def actor_dates_selected(spark, d):
    turns = B.official_turns(spark, d)
    resolved = actors.resolve(turns)
    found = actors.actor_dates(turns, resolved, actors.ranking(resolved, 3))
    return found.groupBy("nombre", "fecha").agg(F.count("*").alias("turnos"))


@query
def corpus_newest_first(spark, d):
    return kwic.newest_first(kwic.corpus(B.turns(spark, d))).select("orden", "fecha", "conv_id", "turno")


ORACLE_SQL = oracle.build(vocab.lexical_stops(), vocab.digest_stops(), TEST_FRAMES, TERM, PHRASE)
