"""Listing pages of archives, in order: what each shows, and where a scan stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.dates import slug_date
from turnlens.sources.pages import ANY_SLUG, START, absolute

#: Fixed values of the scan.
ARTICLES = "/articulos/"
PATIENCE = 5
MOST_PAGES = 200
#: Why a scan stops at a page.
TIMEOUTS, EMPTY, OLDER, IRRELEVANT = "sin respuesta", "sin artículos", "anteriores", "sin resultados"


def page_url(page: Column, site: str, first: str = "/archivo/articulos") -> Column:
    """The address of a listing page; the first one has a shape of its own."""
    later = F.format_string(site + first + "?filter_origin=archive&idiom=es&order=DESC&page=%d", page)
    return F.when(page == 1, site + first).otherwise(later)


def shown(pages: DataFrame, site: str, slug: str = ANY_SLUG) -> DataFrame:
    """(archive, page, ok, articles, links): what each page shows, once a page.

    ``pages``: archive, page, status ('ok' or else it did not answer), html. Links
    are the dated ones of articles, with pos, url and fecha, in page order. Of
    rows of one page an answered one counts, then the smallest.
    """
    answered = F.coalesce(F.col("status") == "ok", F.lit(False))
    one = pages.groupBy("archive", "page").agg(F.min(F.struct((~answered).alias("silent"), F.coalesce("html", F.lit("")).alias("html"))).alias("p"))
    # set apart by a generator: a lambda would find the articles anew for each link
    articles = F.regexp_extract_all("p.html", F.lit(r"(?is)<article[\s>].*?</article\s*>"), F.lit(0))
    rows = one.select("archive", "page", (~F.col("p.silent")).alias("ok"), F.explode(F.array(articles)).alias("a"))
    hrefs = F.flatten(F.transform("a", lambda a: F.regexp_extract_all(a, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))))
    kept = F.filter(hrefs, lambda h: h.contains(ARTICLES) & h.contains(slug))
    rows = rows.select("archive", "page", "ok", F.size("a").alias("articles"), F.explode(F.array(F.transform(kept, lambda h: absolute(h, site)))).alias("u"))
    dated = F.filter(F.transform("u", lambda u, i: F.struct(i.alias("pos"), u.alias("url"), slug_date(u).alias("fecha"))), lambda s: s["fecha"].isNotNull())
    return rows.select("archive", "page", "ok", F.when(F.col("ok"), F.col("articles")).otherwise(0).alias("articles"), F.when(F.col("ok"), dated).otherwise(F.array()).alias("links"))


def _visited(seen: DataFrame, start: str, patience: int, most: int) -> DataFrame:
    """The pages of :func:`shown` up to the one at which their archive's scan stops, with ``reason`` there.

    Pages that follow each other without an answer form a run: in it, the place
    among all pages and that among such pages advance together.
    """
    # an archive has at most ``most`` pages, so these windows are bounded
    order, silent = Window.partitionBy("archive").orderBy("page"), Window.partitionBy("archive", "ok").orderBy("page")
    rows = seen.where(F.col("page").between(1, most)).withColumn("run", F.row_number().over(order) - F.row_number().over(silent))
    lasting = F.row_number().over(Window.partitionBy("archive", "ok", "run").orderBy("page"))
    since = F.lit(start).cast("date")
    reason = (
        F.when(~F.col("ok"), F.when(lasting >= patience, TIMEOUTS))
        .when(F.col("articles") == 0, EMPTY)
        .when(F.exists("links", lambda s: s["fecha"] < since), OLDER)
        .when(~F.exists("links", lambda s: s["fecha"] >= since) & (F.col("page") > 1), IRRELEVANT)
    )
    rows = rows.withColumn("reason", reason)
    stop = F.min(F.when(F.col("reason").isNotNull(), F.col("page"))).over(Window.partitionBy("archive"))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).drop("run")


def scan(pages: DataFrame, site: str, slug: str = ANY_SLUG, start: str = START, patience: int = PATIENCE, most: int = MOST_PAGES) -> DataFrame:
    """(archive, url, fecha, page, pos): the links since ``start`` on the pages of each archive until its scan stops, each once, where it came first.

    A scan stops behind the page that is the ``patience``-th in a row without an
    answer, at one without articles, at one with a link of before ``start``, and,
    but for page 1, at one without a link of since then; no page after number
    ``most`` is read. Pages without an answer show nothing.
    """
    visited = _visited(shown(pages, site, slug), start, patience, most)
    links = visited.select("archive", "page", F.inline("links")).where(F.col("fecha") >= F.lit(start).cast("date"))
    first = links.groupBy("archive", "url", "fecha").agg(F.min(F.struct("page", "pos")).alias("at"))
    return first.select("archive", "url", "fecha", "at.page", "at.pos")


def stops(pages: DataFrame, site: str, slug: str = ANY_SLUG, start: str = START, patience: int = PATIENCE, most: int = MOST_PAGES) -> DataFrame:
    """(archive, paginas, sin_respuesta, parada, motivo): pages read, those without an answer, the page at which the scan stopped and why; null where it did not."""
    visited = _visited(shown(pages, site, slug), start, patience, most)
    return visited.groupBy("archive").agg(
        F.count("*").alias("paginas"), F.count_if(~F.col("ok")).alias("sin_respuesta"), F.max("stop").alias("parada"), F.max(F.when(F.col("page") == F.col("stop"), F.col("reason"))).alias("motivo")
    )
