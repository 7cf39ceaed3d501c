"""Officials: participants, identities across spellings, office holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions import names
from turnlens.functions.text import strings, strip_accents
from turnlens.session import checkpointed

OFFICE_SHARE = 0.6
TOP = 100


def variants(turns: DataFrame) -> DataFrame:
    """(variante, n, clave): normalised labels of officials with their turns and merge keys."""
    label = names.normal_label(F.col("hablante"))
    counts = turns.where("tipo = 'funcionario'").groupBy(label.alias("variante")).agg(F.count("*").alias("n"))
    return counts.withColumn("clave", names.merge_key(F.col("variante")))


def participants(turns: DataFrame, compat_squared: bool = False) -> DataFrame:
    """(nombre, cargo, categoria, intervenciones): one row an official, under the commonest spelling (ties: the first by name).

    The most interventions come first, then by name. ``compat_squared`` counts each turn as often as its spelling has turns.
    """
    n = F.col("n") * F.col("n") if compat_squared else F.col("n")
    canon = F.min_by("variante", F.struct(-F.col("n"), "variante"))
    merged = variants(turns).groupBy("clave").agg(canon.alias("canon"), F.sum(n).alias("intervenciones"))
    c = F.col("canon")
    return merged.select(
        names.name_segment(c).alias("nombre"), names.role_segment(c).alias("cargo"), names.category(c).alias("categoria"), "intervenciones"
    ).orderBy(F.desc("intervenciones"), "nombre")


def question_count(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_if(F.col("tipo") == "pregunta").alias("n_preguntas"))


def groups(found: DataFrame) -> DataFrame:
    """(clave, canon, total, categoria, tokens) of each merge key of :func:`variants`."""
    merged = found.groupBy("clave").agg(F.min_by("variante", F.struct(-F.col("n"), "variante")).alias("canon"), F.sum("n").alias("total"))
    return merged.withColumns({"categoria": names.category(F.col("canon")), "tokens": names.name_tokens(F.col("canon"))})


def containment_edges(found: DataFrame) -> DataFrame:
    """(a, b), a < b: groups of one category and first token of which one's tokens, two at least, contain the other's.

    What contains a set contains its rarest token, so each set is looked for only
    among those that hold that token: names that share a first token, however
    many, meet by their rare ones.
    """
    side = found.where(F.size("tokens") > 0).select("clave", "categoria", F.get("tokens", F.lit(0)).alias("primero"), F.array_distinct("tokens").alias("t"))
    side = checkpointed(side.where(F.size("t") >= 2))
    held = side.select("clave", "categoria", "primero", F.explode("t").alias("token"), F.size("t").alias("size")).where("token <> primero")
    often = held.groupBy("categoria", "primero", "token").agg(F.count("*").alias("n"))
    ranked = held.join(often, ["categoria", "primero", "token"])
    rare = ranked.groupBy("clave").agg(F.min_by(F.struct("categoria", "primero", "token", "size"), F.struct("n", "token")).alias("r"))
    short = rare.select(F.col("clave").alias("s"), "r.categoria", "r.primero", "r.token", F.col("r.size").alias("s_size"))
    long = held.select(F.col("clave").alias("l"), "categoria", "primero", "token", F.col("size").alias("l_size"))
    pairs = short.join(long, ["categoria", "primero", "token"]).where("s <> l AND s_size <= l_size").select("s", "l")
    sets = side.select("clave", "t")
    both = pairs.join(sets.select(F.col("clave").alias("s"), F.col("t").alias("x")), "s").join(sets.select(F.col("clave").alias("l"), F.col("t").alias("y")), "l")
    edges = both.where(F.size(F.array_except("x", "y")) == 0)
    return edges.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(clave, grupo): the smallest key each group is connected with.

    Nodes are spellings of officials' names, so labels travel a few steps; each
    step is checkpointed, which cuts lineage. Without edges there is nothing to do.
    """
    both = checkpointed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = nodes.select("clave", F.col("clave").alias("grupo"))
    if both.isEmpty():
        return labels
    while True:
        near = both.join(labels.select(F.col("clave").alias("b"), F.col("grupo").alias("g")), "b").groupBy(F.col("a").alias("clave")).agg(F.min("g").alias("g"))
        new = checkpointed(labels.join(near, "clave", "left").select("clave", F.col("grupo").alias("old"), F.least("grupo", "g").alias("grupo")))
        labels = new.select("clave", "grupo")
        if new.where("old <> grupo").isEmpty():
            return labels


def _role_words(label):
    known = strings(vocab.PARTICLES)
    toks = F.filter(F.split(F.replace(strip_accents(label), F.lit(","), F.lit("")), r"(?U)\s+"), lambda t: (t != "") & ~F.array_contains(known, t))
    return F.array_distinct(toks)


def office_match(people: DataFrame) -> DataFrame:
    """(clave, titular, score): for each group without a name the office holder whose role words it covers best.

    ``people``: clave, canon, total, categoria. At least OFFICE_SHARE of the
    holder's role words; ties go to the holder with more turns, then by name.
    Commas are no part of a word, and only named groups are holders. Groups and
    holders meet by the rarest role words, of which a match must hold one.
    """
    nameless = names.has_role(names.name_segment(F.col("canon")))
    lone = people.where(nameless).select("clave", "categoria", _role_words(F.col("canon")).alias("own"))
    holder = people.where(~nameless).select(
        F.col("clave").alias("titular"),
        F.col("total").alias("t_total"),
        F.col("canon").alias("t_canon"),
        "categoria",
        F.array_except(_role_words(F.col("canon")), _role_words(names.name_segment(F.col("canon")))).alias("role"),
    )
    # of a holder's r role words at least m must be covered, so one of any r - m + 1; the rarest ones are indexed
    words = lone.select("clave", "categoria", F.explode("own").alias("word"))
    often = words.groupBy("categoria", "word").agg(F.count("*").alias("n"))
    role = holder.where(F.size("role") > 0).select("titular", "categoria", F.size("role").alias("r"), F.explode("role").alias("word"))
    role = role.join(often, ["categoria", "word"], "left").groupBy("titular", "categoria", "r").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
    least = F.ceil(F.col("r") * int(OFFICE_SHARE * 10) / 10).cast("int")
    index = role.select("titular", "categoria", F.explode(F.slice("w", F.lit(1), F.col("r") - least + 1)).alias("s")).select("titular", "categoria", "s.word")
    pairs = words.join(index, ["categoria", "word"]).select("clave", "titular").distinct()
    both = pairs.join(lone.select("clave", "own"), "clave").join(holder.select("titular", "t_total", "t_canon", "role"), "titular")
    score = F.size(F.array_intersect("own", "role")) / F.size("role")
    found = both.withColumn("score", score).where(F.col("score") >= OFFICE_SHARE)
    best = found.groupBy("clave").agg(F.min_by(F.struct("titular", "score"), F.struct(-F.col("score"), -F.col("t_total"), "t_canon", "titular")).alias("b"))
    return best.select("clave", "b.titular", F.round("b.score", 4).alias("score"))


def resolve(turns: DataFrame) -> DataFrame:
    """(variante, n, nombre): each spelling of an official with the name it is counted under.

    Spellings merge by key, groups by contained names, groups without a name
    with their office holder.
    """
    found = checkpointed(variants(turns))
    merged = checkpointed(groups(found))
    linked = connected(merged, containment_edges(merged))
    first = checkpointed(found.join(linked, "clave").select("variante", "n", F.col("grupo").alias("clave")))
    people = checkpointed(groups(first))
    match = office_match(people).select("clave", "titular")
    final = first.join(match, "clave", "left").select("variante", "n", F.coalesce("titular", "clave").alias("clave"))
    canon = final.groupBy("clave").agg(F.min_by("variante", F.struct(-F.col("n"), "variante")).alias("nombre"))
    return final.join(canon, "clave").select("variante", "n", "nombre")


def ranking(resolved: DataFrame, top: int = TOP) -> DataFrame:
    """(nombre, apariciones, categoria): all governors and secretaries, and the ``top`` officials of all, the most frequent first, then by name."""
    total = resolved.groupBy("nombre").agg(F.sum("n").alias("apariciones")).withColumn("categoria", names.category(F.col("nombre")))
    always = total.where(F.col("categoria").isin("gobernadores", "secretarios"))
    return always.union(total.orderBy(F.desc("apariciones"), "nombre").limit(top)).distinct().orderBy(F.desc("apariciones"), "nombre")


def actor_dates(turns: DataFrame, resolved: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(nombre, fecha), one row a turn, of all officials or of those ``selected`` (nombre)."""
    label = names.normal_label(F.col("hablante"))
    said = turns.where("tipo = 'funcionario'").select(label.alias("variante"), "fecha")
    chosen = resolved.select("variante", "nombre")
    if selected is not None:
        chosen = chosen.join(selected.select("nombre").distinct(), "nombre", "left_semi")
    return said.join(chosen, "variante").select("nombre", "fecha")
