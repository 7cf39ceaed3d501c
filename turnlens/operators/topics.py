"""LDA topics of turns and their means by date and month."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions.dates import period
from turnlens.functions.text import letter_tokens, without
from turnlens.operators.lda import Topics
from turnlens.session import checkpointed

TOPICS, ITERATIONS, SEED, VOCABULARY, MIN_DF, WORDS = 10, 20, 42, 3000, 5, 12
#: Of topics that are given: the weight of their own words, the prior of each, and the steps towards a turn's shares.
OWN, PRIOR, STEPS = 0.9, 0.1, 8
#: Turns a task of the fit takes; tasks follow from the turns and not from files or cores. Where there are more
#: than PASS, a pass joins up to four, as a step for the last few turns of a task costs much of one for many.
TURNS, PASS = 2500, 96


def fit(turns: DataFrame, stops: Iterable[str], k: int = TOPICS) -> tuple[CountVectorizerModel, Topics, DataFrame] | None:
    """The vocabulary, the model and the turns with their counts, without ``texto``; None with fewer than MIN_DF turns or no common word.

    Every pass of the fit reads the counts, so they are stored in the shared folder,
    dealt to tasks by all columns of ``turns``: a table in one file, or one row
    group, is spread as well, and equal turns that differ in any column.
    """
    held = turns.count()
    if held < MIN_DF:
        return None
    tasks = math.ceil(held / TURNS)
    dealt = turns.repartition(tasks, *turns.columns).sortWithinPartitions(*turns.columns)
    tokens = dealt.withColumn("tokens", without(letter_tokens(F.col("texto"), 3), stops))
    vectorizer = vocabulary(tokens, tasks)
    if vectorizer is None:
        return None
    counted = checkpointed(vectorizer.transform(tokens).drop("texto", "tokens"))
    # the weights that MLlib's seed draws, without a pass of its own: these would draw turns anew, with replacement
    drawn = LDA(k=k, maxIter=0, seed=SEED, featuresCol="counts", optimizer="online").fit(counted)
    model = Topics(drawn.topicsMatrix().toArray())
    read = counted.coalesce(min(tasks, max(PASS, math.ceil(tasks / 4))))
    for _ in range(ITERATIONS):
        model = model.next(read)
    return vectorizer, model, counted


def vocabulary(tokens: DataFrame, tasks: int) -> CountVectorizerModel | None:
    """The VOCABULARY most frequent words that MIN_DF turns hold; None if there is none.

    CountVectorizer orders words of equal counts by the task that ends first, which
    only a single task makes the same each time; of several, by name.
    """
    names = {"inputCol": "tokens", "outputCol": "counts"}
    if tasks == 1:
        found = CountVectorizer(vocabSize=VOCABULARY, minDF=MIN_DF, **names).fit(tokens)
        return found if found.vocabulary else None
    # a turn's tokens in order, set apart by a generator; the first of equal ones counts the turn
    ordered = tokens.select(F.explode(F.array(F.array_sort("tokens"))).alias("t"))
    each = F.transform("t", lambda w, i: F.struct(w.alias("w"), ((i == 0) | (F.get("t", i - 1) != w)).cast("int").alias("held")))
    words = ordered.select(F.inline(each)).groupBy("w").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    kept = [r["w"] for r in words.where(F.col("held") >= MIN_DF).orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()]
    return CountVectorizerModel.from_vocabulary(kept, **names) if kept else None


def labels(vectorizer: CountVectorizerModel, model: Topics, words: int = WORDS) -> DataFrame:
    """(topico, rank, termino): the heaviest words of each topic, equal ones by name; the matrix has at most VOCABULARY rows."""
    names, weights = vectorizer.vocabulary, model.topicsMatrix().toArray()
    rows = []
    for topic in range(weights.shape[1]):
        order = sorted(range(len(names)), key=lambda i: (-weights[i, topic], names[i]))
        rows += [(topic, rank + 1, names[i]) for rank, i in enumerate(order[:words])]
    return SparkSession.active().createDataFrame(rows, "topico int, rank int, termino string")


def by_date(model: Topics, counted: DataFrame) -> DataFrame:
    """(fecha, topico, peso): the mean over a date's turns, four digits; a turn without a known word is spread evenly."""
    return means(model.transform(counted).select("fecha", vector_to_array("topicDistribution").alias("v")))


def means(shares: DataFrame) -> DataFrame:
    """(fecha, topico, peso): the mean over a date of turns' shares ``v``, four digits; a turn without any is spread evenly."""
    known = F.exists("v", lambda p: p > 0)
    even = F.transform("v", lambda p: F.lit(1.0) / F.size("v"))
    long = shares.select("fecha", F.posexplode(F.when(known, F.col("v")).otherwise(even)).alias("topico", "p"))
    return long.groupBy("fecha", "topico").agg(F.round(F.avg("p"), 4).alias("peso"))


def matrix(lexicons: dict[str, list[str]], own: float = OWN) -> tuple[list[str], list[list[float]]]:
    """(words, a row for each topic): topics given by lists of words; ``own`` of a topic's weight is spread over its list, the rest over the other words."""
    words = sorted({w for found in lexicons.values() for w in found})
    rows = []
    for found in lexicons.values():
        held, others = len(set(found)), len(words) - len(set(found))
        rows.append([(own if others else 1.0) / held if w in found else (1 - own) / others for w in words])
    return words, rows


def infer(turns: DataFrame, words: list[str], weights: list[list[float]], prior: float = PRIOR, iterations: int = STEPS) -> DataFrame:
    """All columns of ``turns`` with ``v``, the shares of topics that are given by their words' weights.

    From even shares on, each step deals every word of a turn among the topics by
    share times weight, and the sums, the prior added, are the next shares; array
    functions within the row, for a fixed number of steps. A turn without any of
    the words has equal shares.
    """
    tokens = letter_tokens(F.col("texto"))
    # set apart by a generator, or each step would count anew
    count = F.transform(F.array(*map(F.lit, words)), lambda w: F.size(F.filter("_t", lambda t: t == w)).cast("double"))
    rows = turns.select("*", F.explode(F.array(tokens)).alias("_t")).select(*turns.columns, F.explode(F.array(count)).alias("_n"))
    table = F.array(*[F.array(*map(F.lit, row)) for row in weights])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    k = len(weights)

    def step(shares: Column, _: Column) -> Column:
        mixed = [total(F.zip_with(shares, F.transform(table, _at(w)), lambda s, b: s * b)) for w in range(len(words))]
        part = F.zip_with("_n", F.array(*mixed), lambda n, m: n / m)
        taken = F.zip_with(shares, table, lambda s, row: s * total(F.zip_with(part, row, lambda p, b: p * b)) + prior)
        return F.transform(taken, lambda x: x / (total("_n") + k * prior))

    even = F.array(*[F.lit(1.0 / k)] * k)
    return rows.withColumn("v", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), even, step)).drop("_n")


def _at(place: int):
    return lambda row: F.get(row, place)


def by_month(dates: DataFrame) -> DataFrame:
    """(mes, topico, peso): the mean of the dates' rounded means, each date once."""
    return dates.groupBy(period(F.col("fecha")).alias("mes"), "topico").agg(F.round(F.avg("peso"), 4).alias("peso"))


def percent_pivot(months: DataFrame, k: int = TOPICS) -> DataFrame:
    """A column a topic in whole percent, 0 where a month lacks it."""
    named = months.select("mes", F.concat(F.lit("t"), F.col("topico")).alias("t"), F.round(F.col("peso") * 100).cast("int").alias("pct"))
    return named.groupBy("mes").pivot("t", [f"t{i}" for i in range(k)]).agg(F.first("pct")).fillna(0)
