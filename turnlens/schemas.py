"""Schemas of the tables that operators exchange."""

from __future__ import annotations

DOCUMENT = "file string, url string, fecha string, titulo string, incompleto boolean, body string"
TURN = "file string, turno bigint, tipo string, hablante string, texto string"
DIGEST = (
    "fecha string, titulo string, url string, incompleto boolean, n_preguntas bigint, temas array<string>, "
    "participantes array<struct<nombre:string,cargo:string,categoria:string,intervenciones:bigint>>"
)
STORED_TURN = "file string, turno bigint, tipo string, hablante string, texto string, fecha string, conv_id string"
