"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "a-záéíóúüñ"
SENTENCE_END = ".?!…"


def strings(values: Iterable[str]) -> Column:
    """An array literal."""
    found = [F.lit(v) for v in values]
    return F.array(*found) if found else F.array().cast("array<string>")


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    return F.split(F.regexp_replace(x, r"\R\z", ""), r"\R")


def clean_paragraphs(x: Column) -> Column:
    """Lines stripped, blank ones dropped, joined by a line feed."""
    return F.array_join(F.filter(F.transform(lines(x), strip), lambda s: s != ""), "\n")


def words(x: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda s: s != "")


def word_count(x: Column) -> Column:
    """Number of white-space words; punctuation by itself counts."""
    return F.size(words(x)).cast("long")


def letter_tokens(x: Column, least: int = 1) -> Column:
    """Runs of at least ``least`` letters of the lower-cased text; other letters split them."""
    size = "+" if least == 1 else f"{{{least},}}"
    return F.regexp_extract_all(F.lower(x), F.lit(f"[{LETTERS}]{size}"), F.lit(0))


def without(tokens: Column, stops: Iterable[str]) -> Column:
    """Tokens that aren't stop words; ``isin`` becomes a hash set, unlike a search through an array."""
    known = list(stops)
    return F.filter(tokens, lambda t: ~t.isin(known))


def adjacent_bigrams(tokens: Column, stops: Iterable[str]) -> Column:
    """Pairs of neighbours neither of which is a stop word."""
    known = list(stops)
    pair = F.zip_with(tokens, _rest(tokens), lambda a, b: F.when(~a.isin(known) & ~b.isin(known), F.concat_ws(" ", a, b)))
    return F.filter(pair, lambda p: p.isNotNull())


def bigrams(tokens: Column) -> Column:
    """Pairs of neighbours."""
    return F.filter(F.zip_with(tokens, _rest(tokens), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def _rest(tokens: Column) -> Column:
    """All but the first, to be zipped with all: asking for a place inside a lambda would find the tokens anew for each."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))


@cache
def _bases() -> tuple[str, str]:
    """The letters that are a single letter and marks, and these letters, from the character data."""
    found = []
    for code in range(0xA0, 0x3000):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if base != letter and len(base) == 1:
            found.append((letter, base))
    return "".join(x for x, _ in found), "".join(y for _, y in found)


def strip_accents(x: Column) -> Column:
    """Upper case without marks: a base letter for each letter with marks of the alphabets below U+3000, combining marks dropped."""
    return F.regexp_replace(F.translate(F.upper(x), *_bases()), r"\p{Mn}", "")


def capitalise(x: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))


def whole_word(term: str) -> str:
    """A pattern of a term that no letter touches."""
    return f"(?<![{LETTERS}]){re.escape(term)}(?![{LETTERS}])"


def highlight(x: Column, term: str) -> Column:
    """Whole-word matches of a term, in any case, wrapped in <mark>."""
    return F.regexp_replace(x, f"(?iu)(?<![{LETTERS}])({re.escape(term)})(?![{LETTERS}])", "<mark>$1</mark>")


def offsets(x: Column, term: str) -> Column:
    """Start of each whole-word match in the lower-cased text, from 0."""
    pieces = F.split(F.lower(x), whole_word(term), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    walk = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        zero,
        lambda a, p: F.struct(
            (a["at"] + F.length(p) + len(term)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(pieces) > 1, walk).otherwise(F.array().cast("array<int>"))


def context(x: Column, at: Column, size: int, around: int) -> Column:
    """``around`` characters on each side of a match, with … where the text goes on."""
    low = F.greatest(F.lit(0), at - around)
    high = F.least(F.length(x), at + size + around)
    left = F.when(low > 0, F.lit("…")).otherwise(F.lit(""))
    right = F.when(high < F.length(x), F.lit("…")).otherwise(F.lit(""))
    return F.concat(left, F.substr(x, low + 1, high - low), right)


def sentence(x: Column, at: Column, size: int) -> Column:
    """The sentence around a match, its end mark included."""
    before = F.regexp_extract(F.left(x, at), f"[^{SENTENCE_END}]*$", 0)
    after = F.regexp_extract(F.substr(x, at + size + 1), f"^[^{SENTENCE_END}]*[{SENTENCE_END}]?", 0)
    return strip(F.concat(before, F.substr(x, at + 1, F.lit(size)), after))


def encode_component(x: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(x)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def fragment_link(url: Column, text: Column) -> Column:
    """A link to a sentence: whole if it has at most 160 characters or 12 words, else its first 8 and last 6 words."""
    w = words(text)
    whole = F.concat(url, F.lit("#:~:text="), encode_component(text))
    ends = F.concat(
        url,
        F.lit("#:~:text="),
        encode_component(F.array_join(F.slice(w, 1, 8), " ")),
        F.lit(","),
        encode_component(F.array_join(F.slice(w, F.greatest(F.size(w) - 5, F.lit(1)), F.lit(6)), " ")),
    )
    return F.when(text == "", url).when((F.length(text) <= 160) | (F.size(w) <= 12), whole).otherwise(ends)
