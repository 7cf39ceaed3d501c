"""License scans by an exact set-similarity join, in DataFrame operations only.

A block matches a template if it holds at least THRESHOLD of the template's
distinct words. Blocks are the lines of a text and, since grants are wrapped,
stretches of a paragraph (up to a blank line), or of the whole text for license
texts, which have several paragraphs: a word and as many words on either side as
a template that holds it needs. Template words are ordered by how many documents
have them, rarest first; a matching block must hold one of the first
``n - ceil(THRESHOLD * n) + 1`` of a template's n words, so only documents with
such a word are taken apart, and only blocks with such a word, enough words and
enough words left behind the shared one are compared whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import small

#: Texts that match a template are broadcast up to this many, else joined by a shuffle.
FEW = 20_000
#: Percent of a template's words that a block must hold.
THRESHOLD = 80
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Templates of more words than this are looked for across paragraphs.
LONG = 80
#: Phrases and their labels are fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates are the notices by which the licenses are usually named or granted, and the texts of the short ones, fixed values all.
TEMPLATES = {
    "mit_notice": ("mit", "Released under the MIT License."),
    "mit_grant": (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "apache_notice": ("apache", "Licensed under the Apache License, Version 2.0."),
    "apache_grant": (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at",
    ),
    "gpl_notice": ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    "gpl_grant": (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
    "bsd_grant": (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "mit_text": (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "isc_text": (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "bsd_text": (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "cc_by_nc_notice": ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    "cc_by_notice": ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
}


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[0-9a-z]+", text.lower())


def _lower(text: Column) -> Column:
    """Lower case as far as words of a-z go: the one other character that becomes one of them is replaced first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("æ")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def required(n: int, threshold: int) -> int:
    """Shared words needed of a template of n distinct words."""
    return math.ceil(threshold * n / 100)


def word_order(docs: DataFrame, text_col: str, templates: dict) -> list[str]:
    """The templates' words, those in the fewest documents first; counted over all documents."""
    vocabulary = sorted({w for _, text in templates.values() for w in words_of(text)})
    held = F.array_intersect(_words(_lower(F.col(text_col))), _strings(vocabulary))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(docs: DataFrame, key: list[str], text_col: str = "text", templates: dict = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(key, template, label, containment) of each text and template, for the best matching block.

    Texts with equal keys count as one. A null or empty text has no blocks.
    """
    order = {w: i for i, w in enumerate(word_order(docs, text_col, templates))}
    index = []
    length = {name: len(words_of(text)) for name, (_, text) in templates.items()}
    for name, (label, text) in templates.items():
        own = sorted(set(words_of(text)), key=order.get)
        need = required(len(own), threshold)
        index += [(name, label, w, p, own, len(own), need, length[name]) for p, w in enumerate(own[: len(own) - need + 1])]
    schema = "template string, label string, word string, place int, own array<string>, size int, need int, length int"
    table = docs.sparkSession.createDataFrame(index, schema)
    prefix = sorted({row[2] for row in index})
    vocabulary = _strings(list(order))
    texts = docs.select(*key, _lower(F.col(text_col)).alias("_t")).where(F.arrays_overlap(_words(F.col("_t")), _strings(prefix)))
    blocks = (
        texts.select(*key, F.posexplode(F.split("_t", "\n", -1)).alias("line", "_b"))
        .select(*key, "line", F.array_distinct(_words(F.col("_b"))).alias("_w"))
        # in the order of the vocabulary, hence rarest first
        .select(*key, "line", F.size("_w").alias("_n"), F.array_intersect(vocabulary, F.col("_w")).alias("held"))
    )
    probes = blocks.select(*key, "line", "_n", "held", F.posexplode(F.array_intersect("held", _strings(prefix))).alias("_p", "word"))
    # the templates' prefixes are a constant of a few hundred rows
    shared = probes.join(F.broadcast(table), "word")
    left = F.size("held") - F.array_position("held", F.col("word")) + 1
    first = (
        shared.where((F.col("_n") >= F.col("need")))
        .groupBy(*key, "line", "template")
        .agg(
            F.min_by(F.struct("label", "held", "own", "size", "need", "place", left.alias("left")), "place").alias("c"),
        )
        .select(*key, "line", "template", "c.*")
    )
    able = first.where(F.least(F.col("size") - F.col("place"), F.col("left")) >= F.col("need"))
    exact = able.withColumn("n", F.size(F.array_intersect("held", "own"))).where(F.col("n") >= F.col("need"))
    exact = exact.select(*key, "template", "label", "n", "size")
    paragraphs = texts.select(*key, F.explode(F.split("_t", r"\n\s*\n", -1)).alias("_b")).where(F.contains("_b", F.lit("\n")))
    for units, some in ((paragraphs, lambda n: n <= LONG), (texts.select(*key, F.col("_t").alias("_b")), lambda n: n > LONG)):
        own = {name for name, n in length.items() if some(n)}
        if own:
            first = sorted({row[2] for row in index if row[0] in own})
            exact = exact.unionByName(_stretches(units, key, table.where(F.col("template").isin(sorted(own))), first, max(length[n] for n in own)))
    return exact.groupBy(*key, "template", "label").agg(F.max(F.col("n") / F.col("size")).alias("containment"))


def _stretches(units: DataFrame, key: list[str], table: DataFrame, prefix: list[str], longest: int) -> DataFrame:
    """(key, template, label, n, size) of stretches of texts (``_b``) around each prefix word.

    Texts are cut into pieces of ``longest`` words, each with its neighbours, so
    that a row stays small however long a text is.
    """
    words = units.select(*key, _words(F.col("_b")).alias("_w")).where(F.size("_w") > 0)
    piece = lambda k: F.struct(
        (F.least(k, F.lit(1)) * longest).alias("lead"), F.slice("_w", F.greatest(k - 1, F.lit(0)) * longest + 1, (F.least(k, F.lit(1)) + 2) * longest).alias("s")
    )
    pieces = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("_w") / longest).cast("int") - 1), piece))
    pieces = words.select(*key, pieces.alias("c")).select(*key, "c.*").where(F.arrays_overlap(F.slice("s", F.col("lead") + 1, longest), _strings(prefix)))
    before = lambda i: F.least(i, F.lit(longest) - 1)
    around = lambda w, i: F.struct(w.alias("word"), before(i).alias("at"), F.slice("s", i - before(i) + 1, before(i) + longest).alias("near"))
    mine = lambda w, i: (i >= F.col("lead")) & (i < F.col("lead") + longest) & w.isin(prefix)
    hits = F.filter(F.transform("s", lambda w, i: F.when(mine(w, i), around(w, i))), lambda x: x.isNotNull())
    found = pieces.select(*key, F.explode(hits).alias("c")).select(*key, "c.*").join(F.broadcast(table), "word")
    lead = F.least(F.col("at"), F.col("length") - 1)
    block = F.slice("near", F.col("at") - lead + 1, lead + F.col("length"))
    held = found.select(*key, "template", "label", "size", "need", F.size(F.array_intersect(block, F.col("own"))).alias("n"))
    return held.where(F.col("n") >= F.col("need")).select(*key, "template", "label", "n", "size")


def _places(words: Column, phrase: str, label: str) -> Column:
    """Where the words of a phrase stand one after the other."""
    parts = phrase.split(" ")
    here = lambda i: (F.slice(words, i + 1, len(parts)) == _strings(parts))
    place = lambda w, i: F.when((w == parts[0]) & here(i), F.struct(i.alias("start"), F.lit(label).alias("label")))
    return F.filter(F.transform(words, place), lambda x: x.isNotNull())


def scan(docs: DataFrame, text_col: str = "text", templates: dict = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with n_words, places (struct of label and first and last word), templates and score appended.

    ``places`` lists every occurrence of a phrase; ``templates`` the (template,
    label, containment) found; ``score`` the best containment, else 0. A null
    text is empty: no words, no places. Repeated rows are each reported; other
    columns are kept and columns named like the results are replaced.
    """
    key = ["_h1", "_h2"]
    own, text_name = kernel.shielded(docs, text_col)
    kept = [c for c in docs.columns if c not in ("n_words", "places", "templates", "score")]
    text = F.coalesce(F.col(text_name), F.lit(""))
    hashed = own.withColumns({"_h1": F.xxhash64(text), "_h2": F.crc32(text)})
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    named = F.col(text_name).rlike("(?i)" + "|".join(p.replace(" ", gap) for p in PHRASES))
    low = _words(_lower(F.col(text_name)))
    places = F.array().cast("array<struct<start:int,label:string>>")
    found = F.concat(*[_places(F.col("_w"), phrase, label) for phrase, label in PHRASES.items()])
    places = F.when(F.size("_w") == 0, places).otherwise(F.array_sort(found))
    main = hashed.withColumns(
        {"n_words": F.regexp_count(text, F.lit(WORD)).cast("long"), "_w": F.when(named, low).otherwise(F.array().cast("array<string>"))}
    )
    main = main.withColumn("places", places).drop("_w")
    found = matches(hashed.select(text_name, *key), key, text_name, templates, threshold)
    best = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("template", "label", "containment"))).alias("templates"), F.max("containment").alias("score"))
    out = main.join(small(best, FEW), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    names = [f"_own{docs.columns.index(c)}" for c in kept]
    return out.select(*names, "n_words", "places", "templates", "score").toDF(*kept, "n_words", "places", "templates", "score")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels and score."""
    out = scan(docs.select("doc_id", "text"))
    base = F.array_sort(F.array_distinct("places.label"))
    own = F.coalesce(F.col("templates.label"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        "score",
    )
