"""Term frequencies, TF-IDF and the distinctive terms of one document."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions import morphology
from turnlens.functions.dates import period
from turnlens.functions.text import bigrams, capitalise, letter_tokens, without

VOCABULARY = 5000
MIN_DF = 2
MIN_UNIGRAM, MIN_BIGRAM, BIGRAM_WEIGHT, TERMS = 4, 2, 1.4, 6


def top_terms(texts: DataFrame, group: Column, text: str, stops: Iterable[str], k: int = 50) -> DataFrame:
    """(grp, rank, term, n): the k commonest words of three letters or more of each group, ties by term.

    Stop words go after the tokens are set apart, where the test is compiled.
    """
    terms = texts.select(group.alias("grp"), F.explode(letter_tokens(F.col(text), 3)).alias("term"))
    return _top(terms.where(~F.col("term").isin(list(stops))), k)


def tagged_words(texts: DataFrame, keys: list[Column | str], text: str, tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, sentence, pos, word, lemma, tag) of each word of each text.

    ``tagger`` gives (lemma, tag) of the words of a sentence; the default one is
    that of :mod:`turnlens.functions.morphology`. Nothing is shuffled.
    """
    found = texts.select(*keys, F.posexplode(morphology.sentences(F.col(text))).alias("sentence", "_w"))
    tags = found.withColumn("_t", (tagger or morphology.tagger())(F.col("_w")))
    names = [c for c in found.columns if c not in ("sentence", "_w")]
    long = tags.select(*names, "sentence", F.posexplode(F.arrays_zip(F.col("_w").alias("word"), F.col("_t").alias("t"))).alias("pos", "x"))
    return long.select(*names, "sentence", "pos", "x.word", "x.t.lemma", "x.t.tag")


def top_lemmas(texts: DataFrame, group: Column, text: str, stops: Iterable[str], k: int = 50, tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """(grp, rank, term, n): the k commonest lemmas of nouns, verbs, adjectives and adverbs of each group, ties by term.

    Words and lemmas that are stop words, and lemmas of less than three letters, go.
    """
    known = list(stops)
    words = tagged_words(texts, [group.alias("grp")], text, tagger)
    content = words.where(F.col("tag").isin(*morphology.CONTENT) & ~F.lower("word").isin(known) & ~F.col("lemma").isin(known) & (F.length("lemma") > 2))
    return _top(content.select("grp", F.col("lemma").alias("term")), k)


def _top(terms: DataFrame, k: int) -> DataFrame:
    """The k commonest of (grp, term) rows; counts are partial before the shuffle, and the rank keeps k rows a group before sorting."""
    counts = terms.groupBy("grp", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("grp", "rank", "term", "n")


def _boundary_bigrams(rows: DataFrame) -> DataFrame:
    """Bigrams between texts that follow each other in a group.

    ``rows``: grp, part, seq, first, last. Neighbours are looked for within a
    part, then between parts, of which a group has few, so no window holds a
    whole group.
    """
    inner = Window.partitionBy("grp", "part").orderBy("seq")
    placed = rows.withColumns({"before": F.lag("last").over(inner), "next": F.lead("first").over(inner)})
    within = placed.where("before IS NOT NULL").select("grp", "before", F.col("first").alias("after"))
    # the same shuffle serves both
    outermost = placed.where("before IS NULL OR next IS NULL")
    ends = outermost.groupBy("grp", "part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    outer = Window.partitionBy("grp").orderBy("part")
    between = ends.withColumn("before", F.lag("last").over(outer)).where("before IS NOT NULL").select("grp", "before", F.col("first").alias("after"))
    return within.union(between).select("grp", F.concat_ws(" ", "before", "after").alias("term"))


def tfidf(texts: DataFrame, group: Column, part: Column, seq: Column, text: str, stops: Iterable[str], k: int = 20, cap: int = VOCABULARY) -> DataFrame:
    """(grp, rank, term, score): the k best terms of each group of texts, taken as one document in the order (part, seq).

    Unigrams, and bigrams after the stop words are gone; terms of fewer than
    MIN_DF groups go, then all but the ``cap`` commonest (ties by term); idf is
    ln((1 + N) / (1 + df)) + 1, raw counts, Euclidean norm 1, four digits. Fewer
    than MIN_DF groups give no rows.
    """
    tokens = texts.select(group.alias("grp"), part.alias("part"), seq.alias("seq"), without(letter_tokens(F.col(text), 3), stops).alias("t"))
    n_groups = tokens.select("grp").distinct().count()
    own = tokens.select("grp", F.explode(F.concat("t", bigrams(F.col("t")))).alias("term"))
    # inlined rather than filtered: a filter would be pushed below the tokens and find them twice
    edge = F.array(F.struct(F.get("t", F.lit(0)).alias("first"), F.get("t", F.size("t") - 1).alias("last")))
    ends = tokens.select("grp", "part", "seq", F.inline(F.when(F.size("t") > 0, edge)))
    tf = own.unionByName(_boundary_bigrams(ends)).groupBy("grp", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= MIN_DF)
    # an ordered limit keeps ``cap`` rows in each task
    vocabulary = df.orderBy(F.desc("total"), "term").limit(cap).select("term", "df")
    weight = F.col("tf") * (F.log((1.0 + n_groups) / (1.0 + F.col("df"))) + 1.0)
    # at most ``cap`` rows
    weighed = tf.join(F.broadcast(vocabulary), "term").withColumn("w", weight)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("grp")))
    scored = weighed.select("grp", "term", F.round(F.col("w") / norm, 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0)).select("grp", "rank", "term", "score")


def grams(docs: DataFrame, key: str, text: str, stops: Iterable[str]) -> DataFrame:
    """(key, term), one row for each: unigrams that aren't stop words, and neighbours neither of which is one.

    Pairs of neighbours are set apart first, so that the tokens are found once
    and the tests are compiled.
    """
    tokens = F.col("_t")
    found = docs.select(key, F.explode(F.array(letter_tokens(F.col(text), 3))).alias("_t"))
    pairs = found.select(key, F.inline(F.arrays_zip(tokens.alias("a"), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))).alias("b"))))
    known = list(stops)
    a, b = ~F.col("a").isin(known), ~F.col("b").isin(known)
    terms = F.explode(F.array(F.when(a, F.col("a")), F.when(a & b, F.concat_ws(" ", "a", "b"))))
    return pairs.select(key, terms.alias("term")).where("term IS NOT NULL")


def distinctive(docs: DataFrame, target: Column, key: str, text: str, stops: Iterable[str]) -> DataFrame:
    """(rank, term, n, df, score) of the target document's terms against all documents.

    Only the target's terms are counted in the others. The score is
    n * ln(N / df), 1.4 times that for bigrams; ties go to the longer term, then
    by term.
    """
    n_docs = docs.count()
    own = grams(docs.where(target), key, text, stops).groupBy("term").agg(F.count("*").alias("n"))
    two = F.col("term").contains(" ")
    own = own.where(F.col("n") >= F.when(two, MIN_BIGRAM).otherwise(MIN_UNIGRAM))
    # the terms of one document leave few rows to be counted
    found = grams(docs, key, text, stops).join(own.select("term"), "term").distinct()
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    score = F.round(F.col("n") * F.log(F.lit(float(n_docs)) / F.col("df")) * F.when(two, BIGRAM_WEIGHT).otherwise(1.0), 6)
    scored = own.join(df, "term").withColumn("score", score)
    # a window over the terms of one document
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc(F.length("term")), "term"))
    return scored.select(rank.alias("rank"), "term", "n", "df", "score")


def pick(ranked: DataFrame, k: int = TERMS) -> DataFrame:
    """(pos, termino): greedily the k best terms none of which contains another as a string."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])

    def add(acc: Column, t: Column) -> Column:
        covers = F.exists(acc, lambda e: F.contains(e, t) | F.contains(t, e))
        return F.when((F.size(acc) < k) & ~covers, F.concat(acc, F.array(t))).otherwise(acc)

    chosen = ranked.agg(F.aggregate(terms, F.array().cast("array<string>"), add).alias("c"))
    return chosen.select(F.posexplode("c").alias("pos", "t")).select("pos", capitalise(F.col("t")).alias("termino"))


def monthly(turns: DataFrame) -> tuple[Column, Column, Column]:
    """The group, part and order by which turns make a month's document."""
    return period(F.col("fecha")), F.col("fecha"), F.struct("conv_id", "turno")
