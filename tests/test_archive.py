"""The rules by which a scan of listing pages stops, one by one."""

import pytest

from turnlens.sources import archive

SITE = "https://example.org"
GOOD, OLD, OTHER, UNDATED = (
    "version-estenografica-conferencia-de-prensa-del-{}-de-mayo-de-2026",
    "version-estenografica-conferencia-de-prensa-del-{}-de-mayo-de-2023",
    "otra-cosa-del-{}-de-mayo-de-2026",
    "version-estenografica-del-{}-de-foo-de-2026",
)


def listing(*slugs):
    return '<nav><a href="/articulos/version-estenografica-x-del-1-de-enero-de-2020">n</a></nav>' + "".join(f'<article class="a"><a\n href="/articulos/{s}">x</a></article>' for s in slugs)


def run(spark, pages, **more):
    """(pages read, reason, days found) of one archive; a page is None where there was no answer."""
    rows = [("a", i + 1, "timeout" if html is None else "ok", html) for i, html in enumerate(pages)]
    frame = spark.createDataFrame(rows, "archive string, page int, status string, html string").repartition(3)
    stop = archive.stops(frame, SITE, **more).collect()[0]
    found = sorted(archive.scan(frame, SITE, **more).collect(), key=lambda r: (r.page, r.pos))
    return stop.paginas, stop.motivo, [r.fecha.day for r in found]


def good(day):
    return listing(GOOD.format(day))


@pytest.mark.parametrize(
    "pages,read,reason,days",
    [
        ([good(3), good(2)], 2, None, [3, 2]),
        # four silent pages are passed over, and an answer starts the count anew; behind the fifth nothing is read
        ([good(9), None, None, None, None, good(8), None, None, None, None, good(7)], 11, None, [9, 8, 7]),
        ([good(9), None, None, None, None, None, good(7)], 6, archive.TIMEOUTS, [9]),
        ([None, None, None, None, None, good(7)], 5, archive.TIMEOUTS, []),
        ([good(9), listing(), good(7)], 2, archive.EMPTY, [9]),
        # what a page with an older link shows besides still counts
        ([listing(GOOD.format(9), OLD.format(1), GOOD.format(8)), good(7)], 1, archive.OLDER, [9, 8]),
        # the first page may lack relevant links, another one may not
        ([listing(OTHER.format(1)), good(7), listing(OTHER.format(2), UNDATED.format(3)), good(6)], 3, archive.IRRELEVANT, [7]),
        ([listing(OLD.format(1)), good(7)], 1, archive.OLDER, []),
        ([good(9), good(9), good(8)], 3, None, [9, 8]),
    ],
)
def test_rules(spark, pages, read, reason, days):
    assert run(spark, pages) == (read, reason, days)


def test_parameters(spark):
    assert run(spark, [good(9), None, None, good(8)], patience=2) == (3, archive.TIMEOUTS, [9])
    assert run(spark, [good(9), good(8), good(7)], most=2) == (2, None, [9, 8])
    assert run(spark, [good(9), listing(OLD.format(1)), good(8)], start="2020-01-01") == (3, None, [9, 1, 8])


def test_archives_are_apart_and_odd_rows(spark):
    rows = [("a", 1, "ok", good(1)), ("a", 1, "ok", good(1)), ("a", 2, "ok", listing()), ("a", 3, "ok", good(2)), ("b", 1, None, None), ("b", 3, "ok", good(3)), (None, 1, "ok", good(4)), ("c", 1, "ok", None), ("d", 1, "timeout", good(6)), ("d", 1, "ok", good(5))]
    frame = spark.createDataFrame(rows, "archive string, page int, status string, html string")
    assert {(r.archive, r.fecha.day) for r in archive.scan(frame, SITE).collect()} == {("a", 1), ("b", 3), (None, 4), ("d", 5)}
    assert {r.archive: (r.paginas, r.sin_respuesta, r.parada) for r in archive.stops(frame, SITE).collect()} == {"a": (2, 0, 2), "b": (2, 1, None), None: (1, 0, None), "c": (1, 0, 1), "d": (1, 0, None)}
    assert archive.scan(frame.limit(0), SITE).collect() == archive.stops(frame.limit(0), SITE).collect() == []
