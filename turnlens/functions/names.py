"""Speaker names and roles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions.text import strings, strip, strip_accents


def _any(values: list[str]) -> str:
    return "|".join(values)


def speaker_type(label: Column) -> Column:
    """presidenta, pregunta, funcionario or otro, by the first rule that holds."""
    return (
        F.when(label.contains("PRESIDENTA") & label.contains("SHEINBAUM"), "presidenta")
        .when(label == "PREGUNTA", "pregunta")
        .when(label.startswith("INTERVENCIÓN") | label.startswith("VOZ "), "otro")
        .when(label.rlike(_any(vocab.ROLE_WORDS)), "funcionario")
        .otherwise("otro")
    )


def normal_label(label: Column) -> Column:
    """Without one parenthesis at the end."""
    return strip(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", ""))


def has_role(text: Column) -> Column:
    return strip_accents(text).rlike(_any(vocab.ROLE_STEMS))


def segments(label: Column) -> Column:
    """Stripped, non-empty parts between commas."""
    return F.filter(F.transform(F.split(label, ","), strip), lambda s: s != "")


def name_segment(label: Column) -> Column:
    """The part that holds the name, whether the role stands before or after it."""
    segs = segments(label)
    first, last = F.get(segs, F.lit(0)), F.get(segs, F.size(segs) - 1)
    role_first = strip_accents(first).rlike(f"^(?:{_any(vocab.ROLE_STEMS)})")
    pick = F.when(role_first, last).otherwise(first)
    other = F.when(role_first, first).otherwise(last)
    swap = has_role(pick) & ~has_role(other)
    return F.when(F.size(segs) <= 1, first).when(swap, other).otherwise(pick)


def role_segment(label: Column) -> Column:
    """Everything but the name, or the whole label if nothing is left."""
    name = name_segment(label)
    rest = F.array_join(F.filter(segments(label), lambda s: s != name), ", ")
    return F.coalesce(F.nullif(rest, F.lit("")), label)


def name_tokens(label: Column) -> Column:
    """Accent-free words of the name without particles and honorifics."""
    known = strings([*vocab.PARTICLES, *vocab.HONORIFICS])
    return F.filter(F.split(strip_accents(name_segment(label)), r"(?U)\s+"), lambda t: (t != "") & ~F.array_contains(known, t))


def person_key(label: Column) -> Column:
    """The last two tokens of the name, or the whole label if there are none."""
    toks = name_tokens(label)
    two = F.array_join(F.slice(toks, F.greatest(F.size(toks) - 1, F.lit(1)), F.lit(2)), "|")
    return F.when(F.size(toks) == 0, strip_accents(label)).otherwise(two)


def state(label: Column) -> Column:
    """The first of the states named anywhere in a label, else null."""
    u = strip_accents(label)
    found = F.get(F.filter(strings(vocab.STATES), lambda s: F.contains(u, s)), F.lit(0))
    return F.when(u.rlike("JEF[EA] DE GOBIERNO"), "CIUDAD DE MEXICO").otherwise(found)


def category(label: Column) -> Column:
    """gobernadores, directores, secretarios or otros."""
    u = strip_accents(label)
    elsewhere = u.rlike("SINDICATO|CONFEDERACION|SECRETARI[OA] GENERAL|ESTADOS UNIDOS DE AMERICA") | state(label).isNotNull()
    return (
        F.when(u.rlike("GOBERNADOR|JEF[EA] DE GOBIERNO"), "gobernadores")
        .when(u.contains("DIRECTOR"), "directores")
        .when(u.contains("SECRETARI") & ~elsewhere, "secretarios")
        .otherwise("otros")
    )


def merge_key(label: Column) -> Column:
    """One key for all spellings of an official: the state of a governor, else the person key."""
    governor = (category(label) == "gobernadores") & state(label).isNotNull()
    return F.when(governor, F.concat(F.lit("GOB::"), state(label))).otherwise(person_key(label))


def display_name(label: Column) -> tuple[Column, Column]:
    """(role, name) split at the first comma; without one the label is the name."""
    parts = F.split(label, ",", 2)
    two = F.size(parts) == 2
    return F.when(two, strip(F.get(parts, F.lit(0)))).otherwise(F.lit("")), F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(strip(label))
