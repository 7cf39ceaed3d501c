"""Archive pages that have been fetched: links, titles and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions.dates import slug_date, slug_date_text
from turnlens.functions.text import clean_paragraphs, strip

#: Fixed values of the archive.
PRESS_SLUG = "version-estenografica-conferencia-de-prensa"
ANY_SLUG = "version-estenografica"
START = "2024-10-01"
BODY_LENGTH = 300
SELECTORS = ("div.article-body", "div.content", "div.texto", "div.transcripcion", "article", "main")


def links(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, pos, href) of all anchors, in page order."""
    found = F.regexp_extract_all(F.col(page), F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href"))


def absolute(href: Column, site: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))


def first_of_each(found: DataFrame, key: str = "page_id", url: str = "href") -> DataFrame:
    """Each URL once, where it came first; an aggregate, so no window over all pages."""
    first = found.groupBy(url).agg(F.min(F.struct(key, "pos")).alias("at"))
    return first.select(url, f"at.{key}", "at.pos")


def article_links(found: DataFrame, site: str, slug: str = ANY_SLUG, start: str = START) -> DataFrame:
    """(url, fecha) of articles since a date, each once, in ascending order of dates."""
    url = absolute(F.col("href"), site)
    dated = found.where(F.col("href").contains(slug)).select(url.alias("url"), slug_date(url).alias("fecha"))
    return dated.where(F.col("fecha") >= F.lit(start).cast("date")).distinct().orderBy("fecha", "url")


def latest_article(found: DataFrame, site: str, key: str = "page_id") -> DataFrame:
    """(url, fecha) of the first press conference in page order."""
    url = absolute(F.col("href"), site)
    dated = found.where(F.col("href").contains(PRESS_SLUG)).select(key, "pos", url.alias("url"), slug_date_text(url).alias("fecha"))
    return dated.where("fecha <> ''").orderBy(key, "pos").limit(1).select("url", "fecha")


def element_text(page: Column, tag: str) -> Column:
    """Text of the first element of a name, up to the end tag that belongs to it, tags out, the common references decoded; empty if there is none, null for a null page."""
    start = f"(?is)^.*?<{tag}(?:\\s[^>]*)?>"
    return F.when(page.rlike(start), _plain(_inside(F.regexp_replace(page, start, ""), tag))).when(page.isNotNull(), F.lit(""))


def _plain(inner: Column) -> Column:
    """Text of a piece of markup: scripts and tags out, the common references decoded."""
    text = F.regexp_replace(F.regexp_replace(inner, "(?is)<(script|style)[^>]*>.*?</\\1>", ""), "<[^>]*>", " ")
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def division_text(page: Column, name: str) -> Column:
    """Text of the first div of a class, up to the end tag that belongs to it; empty if there is none."""
    start = f"(?is)^.*?<div\\s(?:[^>]*?\\s)?class\\s*=\\s*[\"'](?:[^\"']*\\s)?{name}(?:\\s[^\"']*)?[\"'][^>]*>"
    # most pages lack the name, and are spared the patterns
    return F.when(page.contains(name) & page.rlike(start), _plain(_inside(F.regexp_replace(page, start, ""), "div"))).otherwise(F.lit(""))


def _inside(rest: Column, name: str) -> Column:
    """What stands before the end tag that belongs to an element whose start tag is in front; all, if it is never closed. Comments hold no tags."""
    rest = F.regexp_replace(rest, "(?s)<!--.*?-->", "")
    tag = f"(?i)</?{name}(?=[\\s>/])[^>]*>"
    steps = F.arrays_zip(F.split(rest, tag, -1).alias("gap"), F.regexp_extract_all(rest, F.lit(tag), F.lit(0)).alias("tag"))
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["n"] + F.length(x["gap"])
        closes = F.startswith(x["tag"], F.lit("</"))
        # -1: the end tag that belongs to the element was met
        new = F.when(closes, acc["open"] - 1).otherwise(acc["open"] + 1)
        size = F.when(new < 0, at).otherwise(at + F.length(F.coalesce(x["tag"], F.lit(""))))
        return F.when(acc["open"] < 0, acc).otherwise(F.struct(F.when(x["tag"].isNull(), acc["open"]).otherwise(new).alias("open"), F.when(x["tag"].isNull(), at).otherwise(size).alias("n")))

    return F.left(rest, F.aggregate(steps, zero, step, lambda a: a["n"]))


def extract_documents(pages: DataFrame, page: str = "html", selectors: tuple[str, ...] = SELECTORS) -> DataFrame:
    """All rows with ``titulo`` (first h1), ``fecha_meta`` and ``texto``: the first of some elements, by tag or by ``div.`` and class, with enough text, else the body."""
    html = F.col(page)
    chosen = [division_text(html, s.removeprefix("div.")) if s.startswith("div.") else element_text(html, s) for s in selectors]
    meta = lambda name: F.regexp_extract(html, f"(?i)<meta\\s[^>]*?{name}[^>]*?content=[\"']([^\"']*)[\"']", 1)
    long_enough = [F.when(F.length(text) > BODY_LENGTH, text) for text in chosen]
    return pages.withColumns(
        {
            "titulo": element_text(html, "h1"),
            "fecha_meta": F.coalesce(
                F.nullif(meta("name=[\"']date[\"']"), F.lit("")), F.left(meta("property=[\"']article:published_time[\"']"), F.lit(10)), F.lit("")
            ),
            "texto": clean_paragraphs(F.coalesce(*long_enough, element_text(html, "body"))),
        }
    )
