"""Formats for people and other programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlens.functions.text import lines, strip


def thousands(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def escape_html(x: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def html_body(x: Column) -> Column:
    """Each line that isn't blank as a paragraph."""
    kept = F.filter(F.transform(lines(x), strip), lambda s: s != "")
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("<p>"), escape_html(s), F.lit("</p>"))), "\n")


def attachment(x: Column) -> Column:
    """Text as base64 of its UTF-8 bytes."""
    return F.base64(F.encode(x, "UTF-8"))
