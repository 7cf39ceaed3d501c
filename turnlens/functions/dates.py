"""Dates and periods. A date is an ISO string, a period a prefix of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions.text import strings



def period(fecha: Column, grain: str = "month") -> Column:
    """The period a date belongs to; an empty date gives an empty period."""
    return F.substring(fecha, 1, {"year": 4, "month": 7, "day": 10}[grain])


def _slug(url: Column) -> tuple[Column, Column, Column]:
    pattern = r"(?U)del-(\d{1,2})-de-(\w+)-de-(\d{4})"
    part = lambda i: F.regexp_extract(url, pattern, i)
    number = F.array_position(strings(vocab.MONTHS), F.lower(part(2)))
    month = F.when(number > 0, F.lpad(number.cast("string"), 2, "0")).otherwise("00")
    return part(3), month, F.lpad(part(1), 2, "0")


def slug_date_text(url: Column) -> Column:
    """yyyy-MM-dd from a slug, 00 for an unknown month, empty without a slug."""
    year, month, day = _slug(url)
    return F.when(year == "", "").otherwise(F.concat_ws("-", year, month, day))


def slug_date(url: Column) -> Column:
    """The date in a slug, null if there is none or it doesn't exist."""
    return F.try_to_date(slug_date_text(url), "yyyy-MM-dd")


def month_label(period_: Column) -> Column:
    """Ene 2025 for 2025-01."""
    names = strings([m[:3].capitalize() for m in vocab.MONTHS])
    return F.concat_ws(" ", F.get(names, F.substring(period_, 6, 2).try_cast("int") - 1), F.substring(period_, 1, 4))


def long_date(fecha: Column) -> Column:
    """5 de mayo de 2026 for 2026-05-05."""
    name = F.get(strings(vocab.MONTHS), F.substring(fecha, 6, 2).try_cast("int") - 1)
    return F.concat_ws(" de ", F.substring(fecha, 9, 2).try_cast("int").cast("string"), name, F.substring(fecha, 1, 4))
