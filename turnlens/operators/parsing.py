"""Transcript lines to speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions.names import speaker_type
from turnlens.functions.text import lines, strip
from turnlens.sources.corpus import BODY_FROM

#: Fixed values of the transcripts' format.
SPEAKER = r"(?s)^([A-ZÁÉÍÓÚÜÑ](?U:[A-ZÁÉÍÓÚÜÑ0-9\s,.\-()])+?)(?U:\s)*:(?U:\s)+(.*)"
ANNOTATION = r"^\(.*\)$|^—.*—$"
END = "—000—"
LABEL_LENGTH = 4


def _set(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """A column set apart by a generator, so that lambdas read it instead of computing it anew for each element."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def segment(files: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, turno, tipo, hablante, texto): the turns of each document, numbered from 0.

    A speaker line opens a turn, other lines are appended to the open one; lines
    before the first speaker and after the end mark go. A document is cut within
    its row, so nothing is shuffled; repeated documents are each cut.
    """
    every = F.slice(lines(F.col(value)), F.lit(BODY_FROM + 1), F.greatest(F.size(lines(F.col(value))) - BODY_FROM, F.lit(0)))
    rows = files.select(F.col(key).alias("_k"), F.explode(F.array(F.filter(F.transform(every, strip), lambda s: s != ""))).alias("_b"))
    end = F.array_position("_b", END)
    rows = _set(rows, "_l", F.slice("_b", F.lit(1), F.when(end > 0, end.cast("int") - 1).otherwise(F.size("_b")))).drop("_b")
    label = lambda s: strip(F.regexp_extract(s, SPEAKER, 1))
    opens = lambda s: ~s.rlike(ANNOTATION) & (F.length(label(s)) >= LABEL_LENGTH)
    rows = _set(rows, "_h", F.transform("_l", lambda s: F.when(opens(s), label(s))))
    rows = _set(rows, "_s", F.filter(F.transform("_h", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()))
    said = lambda s, i: F.when(F.get("_h", i).isNull(), s).otherwise(strip(F.regexp_extract(s, SPEAKER, 2)))
    rows = _set(rows, "_t", F.transform("_l", said))
    size = lambda i, k: F.coalesce(F.get("_s", k + 1), F.size("_l")) - i
    turn = lambda i, k: F.struct(
        k.cast("long").alias("turno"), F.get("_h", i).alias("hablante"), strip(F.array_join(F.slice("_t", i + 1, size(i, k)), " ")).alias("texto")
    )
    turns = rows.select("_k", F.inline(F.transform("_s", turn)))
    return turns.select(F.col("_k").alias(key), "turno", speaker_type(F.col("hablante")).alias("tipo"), "hablante", "texto")
