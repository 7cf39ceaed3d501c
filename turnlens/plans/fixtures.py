"""Small literal inputs of queries whose form the synthetic tables lack."""

from __future__ import annotations

from turnlens.sources.bindings import LABELS as OFFICIALS


LABELS = [
    *OFFICIALS,
    "PRESIDENTA DE MÉXICO, CLAUDIA SHEINBAUM PARDO",
    "PREGUNTA",
    "VOZ MUJER",
    "INTERVENCIÓN",
    "IMSS",
    "CÓNSUL GENERAL, RITA MAR",
    "SECRETARIO DE SALUD, JUAN HIDALGO",
    "LA DRA. ROSA DÍAZ",
    "SUBSECRETARIA DE PAZ, DRA ELENA DE LA FUENTE ÁVILA",
]
