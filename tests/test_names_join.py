"""Name containment and office matching against all pairs, on skewed input."""

import random

import pytest
from pyspark.sql import functions as F

from turnlens.operators import actors

GROUP = "clave string, canon string, total bigint, categoria string, tokens array<string>"


def contained(rows):
    out = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[3] == y[3] and x[4] and y[4] and x[4][0] == y[4][0]:
                short, long = sorted((set(x[4]), set(y[4])), key=len)
                if len(short) >= 2 and short <= long:
                    out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        size = rng.choice([0, 1, 1, 2, 2, 3, 4])
        tokens = [rng.choice("AB")] + [rng.choice("CDEFGHIJAB") for _ in range(size - 1)] if size else []
        rows.append((f"k{i}", f"c{i}", 1, rng.choice(["x", "y"]), tokens))
    got = {(r.a, r.b) for r in actors.containment_edges(spark.createDataFrame(rows, GROUP).repartition(4)).collect()}
    assert got == contained(rows) and got


def test_one_hot_first_name(spark):
    n = 100_000
    names = spark.range(n).select(
        F.concat(F.lit("k"), F.col("id")).alias("clave"),
        F.lit("c").alias("canon"),
        F.lit(1).cast("long").alias("total"),
        F.lit("otros").alias("categoria"),
        # a third are contained in the name before them
        F.when(F.col("id") % 3 == 2, F.array(F.lit("JUAN"), F.concat(F.lit("A"), F.col("id") - 1), F.lit("PEREZ")))
        .otherwise(F.array(F.lit("JUAN"), F.lit("PEREZ"), F.concat(F.lit("A"), F.col("id")), F.concat(F.lit("B"), F.col("id") % 1000)))
        .alias("tokens"),
    )
    assert actors.containment_edges(names).count() == n // 3


def office(rows):
    """The best holder of each nameless group, by role words."""
    out = {}
    for clave, canon, _, cat in rows:
        if not canon.startswith("TITULAR"):
            continue
        own, best = set(canon.split()), None
        for other, held, total, c in rows:
            if c == cat and not held.startswith("TITULAR"):
                role = set(held.split(", ")[1].split()) - set(held.split(", ")[0].split())
                score = len(own & role) / len(role) if role else 0
                if score >= actors.OFFICE_SHARE:
                    best = min(best or (9, 0, "", ""), (-score, -total, held, other))
        if best:
            out[clave] = (best[3], round(-best[0], 4))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_office_match_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(["TITULAR", "UNO", "DOS", "TRES", "CUATRO", "CINCO", "SEIS", "SIETE", "OCHO"]) for _ in range(k))
    rows = [(f"n{i}", f"TITULAR {pick(rng.randrange(6))}", 1, rng.choice("xy")) for i in range(60)]
    rows += [(f"h{i}", f"ANA SOL{i}, TITULAR {pick(rng.randrange(1, 7))}", rng.randrange(3), rng.choice("xy")) for i in range(60)]
    people = spark.createDataFrame(rows, "clave string, canon string, total bigint, categoria string").repartition(4)
    got = {r.clave: (r.titular, r.score) for r in actors.office_match(people).collect()}
    assert got == office(rows) and got
