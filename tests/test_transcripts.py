"""Facts that have been counted by hand, and the corners of the format."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnlens import vocab
from turnlens.functions import dates, names
from turnlens.functions import text as T
from turnlens.functions.export import attachment, html_body, thousands
from turnlens.operators import actors, kwic, parsing, stats, terms, timeline, topics
from turnlens.plans import marts, registry
from turnlens.sources import corpus, pages, records
from turnlens.streaming.ingest import ingest

SAMPLE = str(Path(__file__).parent / "data" / "transcripts")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def sample(spark):
    return marts.load(spark, SAMPLE)


def test_sample_turns(sample):
    docs, turns = sample
    rows = {(r["fecha"], r["turno"]): r for r in turns.collect()}
    march = ["presidenta", "otro", "funcionario", "funcionario", "funcionario", "pregunta", "presidenta", "pregunta", "presidenta"]
    april = ["presidenta", "funcionario", "pregunta", "otro", "presidenta"]
    assert {k: r["tipo"] for k, r in rows.items()} == {("2025-03-04", i): t for i, t in enumerate(march)} | {("2025-04-02", i): t for i, t in enumerate(april)}
    assert rows["2025-03-04", 3]["hablante"] == "DIRECTOR GENERAL DEL AGUA, PEDRO SALAS"
    assert rows["2025-03-04", 1]["texto"] == "El acueducto llega a la sierra. (FINALIZA VIDEO)"
    words = turns.select("fecha", "turno", T.word_count(F.col("texto")).alias("n"), F.size(T.letter_tokens(F.col("texto"), 3)).alias("m")).collect()
    found = {(r["fecha"], r["turno"]): (r["n"], r["m"]) for r in words}
    assert [found["2025-03-04", i] for i in range(9)] == [(22, 17), (8, 5), (25, 18), (7, 5), (3, 2), (4, 3), (6, 5), (3, 1), (3, 2)]
    assert [found["2025-04-02", i] for i in range(5)] == [(11, 7), (12, 9), (2, 2), (4, 3), (4, 3)]
    assert {r["fecha"]: (r["incompleto"], r["titulo"]) for r in docs.collect()} == {
        "2025-03-04": (False, "Conferencia del 4 de marzo"),
        "2025-04-02": (True, "Conferencia del 2 de abril"),
    }


def test_sample_framing_and_kwic(sample):
    _, turns = sample
    found = {(r["scope"], r["mes"], r["frame"]): (r["hits"], r["por_mil"]) for r in stats.framing(turns).where("hits > 0").collect()}
    assert found == {
        ("presidenta", "2025-03", "nosotros"): (4, 129.032),
        ("presidenta", "2025-03", "crisis"): (1, 32.258),
        ("presidenta", "2025-03", "logro"): (1, 32.258),
        ("presidenta", "2025-04", "logro"): (1, 66.667),
        ("total", "2025-03", "nosotros"): (4, 49.383),
        ("total", "2025-03", "crisis"): (1, 12.346),
        ("total", "2025-03", "logro"): (1, 12.346),
        ("total", "2025-03", "ciencia"): (1, 12.346),
        ("total", "2025-04", "logro"): (1, 30.303),
        ("total", "2025-04", "ciencia"): (1, 30.303),
    }
    assert kwic.hits(kwic.corpus(turns), "acueducto").count() == 3


def test_sample_marts(sample, tmp_path):
    docs, turns = sample
    tables = marts.marts(docs, turns)
    marts.write(tables, str(tmp_path), "json")
    rows = lambda name: [json.loads(x) for f in (tmp_path / name).glob("*.json") for x in f.read_text().splitlines()]
    assert {r["fecha"]: (r["total_words"], r["presidenta_words"]) for r in rows("corpus_stats")} == {"2025-03-04": (81, 31), "2025-04-02": (33, 15)}
    digest = rows("resumen_ultima")[0]
    assert digest["temas"] == ["Puente", "Puerto"] and digest["n_preguntas"] == 1 and digest["incompleto"]
    assert digest["participantes"] == [{"nombre": "L. MARES", "cargo": "SECRETARIA DE OBRAS", "categoria": "secretarios", "intervenciones": 1}]
    assert {r["mes"]: r["pct"] for r in rows("voice_share") if r["tipo"] == "presidenta"} == {"2025-03": 38.3, "2025-04": 45.5}
    assert len(rows("speakers")) == 3 and len(rows("turns")) == 14 and len(rows("stopwords")) == 313
    # newest first, within a date in the order of turns, and the order is a column
    assert [(r["orden"], r["fecha"], r["turno"]) for r in tables["corpus_presidenta"].collect()] == [
        (0, "2025-04-02", 0), (1, "2025-04-02", 4), (2, "2025-03-04", 0), (3, "2025-03-04", 6), (4, "2025-03-04", 8),
    ]
    chosen = {r["nombre"] for r in tables["speakers"].collect()}
    spoken = [(r["nombre"], r["fecha"]) for r in tables["actor_fechas"].collect()]
    assert {n for n, _ in spoken} == chosen and spoken == sorted(spoken)
    assert tables["tfidf_monthly"].count() == 0  # no term of both months
    sizes = {r["tabla"]: r["bytes"] for r in marts.sizes(docs.sparkSession, str(tmp_path)).collect()}
    assert set(sizes) == set(tables) and sizes["corpus_stats"] > 0 and sizes["tfidf_monthly"] == 0
    marts.write({"voice_share": tables["voice_share"]}, str(tmp_path), "json", obsolete=["speakers", "never"])
    assert not (tmp_path / "speakers").exists() and (tmp_path / "voice_share").exists()


def test_marts_of_nothing(spark, tmp_path):
    (tmp_path / "x.txt").write_text("URL: u")
    docs, turns = marts.load(spark, str(tmp_path))
    none = docs.limit(0), turns.limit(0)
    assert marts.digest(*none).count() == 0
    assert marts.digest(docs, turns).count() == 1


@pytest.mark.parametrize(
    ("line", "tipo"),
    [("PREGUNTA:", None), ("VIH: dato", None), ("IMSS: dato", "otro"), ("VOZ MUJER: sí", "otro"), ("—Rommel—.", None), ("(NOTA: x)", None), ("PREGUNTA: ¿y?", "pregunta")],
)
def test_speaker_lines(spark, line, tipo):
    rows = parsing.segment(spark.createDataFrame([("f", f"a\nb\nc\n{line}\nmás")], "file string, value string")).collect()
    assert [r["tipo"] for r in rows] == ([tipo] if tipo else [])


def test_segment_empty_and_null(spark):
    rows = parsing.segment(spark.createDataFrame([("a", None), ("b", ""), ("c", "x\ny\nz")], "file string, value string")).collect()
    assert rows == []


@pytest.mark.parametrize(
    ("label", "name", "key", "category"),
    [
        ("SECRETARIO DE SALUD, DAVID PAZ", "DAVID PAZ", "DAVID|PAZ", "secretarios"),
        ("DAVID PAZ, SECRETARIO DE SALUD", "DAVID PAZ", "DAVID|PAZ", "secretarios"),
        ("CLARA MARINA BRUGADA MOLINA", "CLARA MARINA BRUGADA MOLINA", "BRUGADA|MOLINA", "otros"),
        ("GOBERNADORA DE BAJA CALIFORNIA SUR, ANA RUIZ", "ANA RUIZ", "GOB::BAJA CALIFORNIA SUR", "gobernadores"),
        ("SECRETARIO GENERAL DEL SINDICATO, JUAN LARA", "JUAN LARA", "JUAN|LARA", "otros"),
        ("SECRETARIO DE SALUD, JUAN HIDALGO", "JUAN HIDALGO", "JUAN|HIDALGO", "otros"),
    ],
)
def test_names(spark, label, name, key, category):
    x = F.lit(label)
    assert one(spark, F.struct(names.name_segment(x), names.merge_key(x), names.category(x))) == (name, key, category)


def test_trailing_parenthetical(spark):
    assert one(spark, names.normal_label(F.lit("SECRETARIA X (SX), ANA LUZ (ENLACE VIDEOLLAMADA)"))) == "SECRETARIA X (SX), ANA LUZ"


def test_slug_dates(spark):
    good, bad = F.lit("x-del-5-de-mayo-de-2026"), F.lit("x-del-5-de-foo-de-2026")
    assert one(spark, dates.slug_date_text(good)) == "2026-05-05" and one(spark, dates.slug_date_text(bad)) == "2026-00-05"
    assert str(one(spark, dates.slug_date(good))) == "2026-05-05" and one(spark, dates.slug_date(bad)) is None


def test_tokens_and_bigrams(spark):
    tokens = T.letter_tokens(F.lit("Registro de proveedores çouelle"), 3)
    assert one(spark, tokens) == ["registro", "proveedores", "ouelle"]
    assert one(spark, T.adjacent_bigrams(tokens, ["ouelle"])) == ["registro proveedores"]
    assert one(spark, T.bigrams(F.array().cast("array<string>"))) == []


def test_concordance(spark):
    text = F.lit("El Agua y agua; aguas. agua")
    assert one(spark, T.offsets(text, "agua")) == [3, 10, 23]
    assert one(spark, T.highlight(text, "agua")) == "El <mark>Agua</mark> y <mark>agua</mark>; aguas. <mark>agua</mark>"
    assert one(spark, T.sentence(F.lit("Uno. Dos agua tres! Cuatro"), F.lit(9), 4)) == "Dos agua tres!"
    assert one(spark, T.encode_component(F.lit("a b!~*ñ()'"))) == "a%20b!~*%C3%B1()'"
    assert one(spark, T.fragment_link(F.lit(None).cast("string"), F.lit("x"))) is None
    for bad in ("", "el", "para"):
        with pytest.raises(ValueError):
            kwic.query(bad)


def test_vocabulary_sizes():
    assert len(vocab.functional_stops()) == 313 and len({t for f in vocab.FRAMES.values() for t in f}) == 50


def test_greedy_pick_and_ties(spark):
    rows = [(1, "mundial de"), (2, "mundial"), (3, "agua"), (4, "el agua"), (5, "sol")]
    assert [r["termino"] for r in terms.pick(spark.createDataFrame(rows, "rank int, term string")).orderBy("pos").collect()] == ["Mundial de", "Agua", "Sol"]


def test_topics_invariants(spark):
    rows = registry.topic_share_date(spark, "/root/testdata/sf0.001").groupBy("fecha").agg(F.sum("peso").alias("s"), F.count("*").alias("n")).collect()
    assert rows and all(abs(r["s"] - 1) < 0.01 and r["n"] == topics.TOPICS for r in rows)
    few = spark.createDataFrame([("2025-01-01", "uno dos")], "fecha string, texto string")
    assert topics.fit(few, []) is None


def test_ingest_keeps_state_by_date(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, day, text):
        (source / f"{name}.txt").write_text(f"URL: u\nFecha: {day}\nTítulo: {name}\n\n{text}\n", encoding="utf-8")

    seen = []
    run = lambda: ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"), on_batch=lambda b: seen.append(sorted(r["titulo"] for r in b.collect())))
    stored = lambda: {str(r["fecha"]): r["titulo"] for r in spark.read.parquet(str(tmp_path / "out/documentos")).collect()}
    put("a", "2025-01-01", "a" * 600 + " (CONTINÚA…)")
    put("b", "2025-01-02", "b" * 20)
    put("c", "2025-01-03", "c" * 600)
    put("d", "", "d" * 600)
    assert run() == {"ok": 2, "fallo": 1, "presente": 0}
    # a whole date again; a truncated one still truncated, then whole, then again; a failed one now long enough
    put("e", "2025-01-03", "another " * 100)
    put("f", "2025-01-01", "f" * 600 + " (CONTINÚA…)")
    put("g", "2025-01-01", "g" * 600)
    put("h", "2025-01-01", "h" * 600)
    put("i", "2025-01-02", "i" * 600)
    assert run() == {"ok": 2, "fallo": 1, "presente": 2}
    assert stored() == {"2025-01-01": "g", "2025-01-02": "i", "2025-01-03": "c"}
    assert run() == {"ok": 0, "fallo": 0, "presente": 0} and seen == [["a", "c"], ["g", "i"]]
    log = marts.outcome(spark.read.parquet(str(tmp_path / "out/registro")))
    assert {r["status"]: r["n"] for r in log.collect()} == {"ok": 4, "fallo": 2, "presente": 2}
    # a stream that starts anew over what is stored
    again = ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck2"))
    assert again == {"ok": 0, "fallo": 0, "presente": 8} and stored() == {"2025-01-01": "g", "2025-01-02": "i", "2025-01-03": "c"}


def test_a_failed_batch_is_taken_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("URL: u\nFecha: 2025-01-01\nTítulo: t\n\n" + "a" * 600, encoding="utf-8")
    run = lambda f: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), on_batch=f)

    def refuse(batch):
        raise RuntimeError("no notice was sent")

    with pytest.raises(Exception, match="no notice"):
        run(refuse)
    sent = []
    assert run(lambda b: sent.append(b.count()))["ok"] == 1 and sent == [1]


def test_chain_of_names_is_one_group(spark):
    rows = [("SECRETARIO DE PAZ, " + n,) for n in ("ANA MARÍA DÍAZ", "ANA MARÍA DÍAZ SOL", "ANA MARÍA DÍAZ SOL MAR")]
    turns = spark.createDataFrame(rows, "hablante string").withColumn("tipo", F.lit("funcionario"))
    assert actors.resolve(turns).select("nombre").distinct().count() == 1


def test_empty_corpus(spark):
    turns = spark.createDataFrame([], "conv_id int, fecha string, turno int, tipo string, hablante string, texto string")
    assert stats.by_date(turns).count() == 0 and stats.voice_share(turns).count() == 0 and stats.framing(turns).count() == 0
    assert actors.participants(turns).count() == 0 and kwic.trend(turns, "agua").count() == 0


def test_formats(spark):
    assert one(spark, thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, html_body(F.lit("a < b\n\n c "))) == "<p>a &lt; b</p>\n<p>c</p>"
    assert one(spark, attachment(F.lit("ñ"))) == "w7E="


def test_header_needs_its_place(spark):
    value = "URL: first\nURL: second\nFecha: 2025-01-01\n\nx\nTítulo: too late"
    row = corpus.documents(spark.createDataFrame([("f", value)], "file string, value string")).first()
    assert (row["url"], row["fecha"], row["titulo"]) == ("second", "2025-01-01", "")


def test_json_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"fecha": "2025-03-04", "n": 2}\n{"fecha": null}\n')
    rows = records.read_json(spark, str(tmp_path), "fecha string, n bigint").collect()
    assert {tuple(r) for r in rows} == {("2025-03-04", 2), (None, None)}
    (tmp_path / "a.json").write_text('[{"n": 1},\n {"n": 2}]')
    assert records.read_json(spark, str(tmp_path), "n bigint", array=True).agg(F.sum("n")).first()[0] == 3
    (tmp_path / "a.json").write_text("no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_json(spark, str(tmp_path), "n bigint").collect()


def test_content_selectors(spark):
    long = "Palabra " * 50
    rows = [
        (1, f"<body><div class='x'>no</div><div class='a texto b'><div>{long}</div> y <div>más</div></div><article>{long} otra</article></body>"),
        (2, f"<body><div class='content'>corto</div><article>{long}artículo</article></body>"),
        (3, f"<body><DIV id=q class=\"article-body\">{long}sin cierre</body>"),
        (4, "<body>nada</body>"),
        (5, None),
    ]
    found = {r["k"]: r["texto"] for r in pages.extract_documents(spark.createDataFrame(rows, "k int, html string")).collect()}
    assert found[1].split() == [*long.split(), "y", "más"] and found[2].endswith("artículo")
    assert found[3].endswith("sin cierre") and found[4] == "nada" and found[5] is None


def test_stored_turns(spark, tmp_path):
    """The second load reads what the first one wrote."""
    first = marts.load(spark, SAMPLE, str(tmp_path / "kept"))
    again = marts.load(spark, "/nowhere", str(tmp_path / "kept"))
    for a, b in zip(first, again, strict=True):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert again[1].count() == 14


def test_actor_choice(spark):
    events = spark.createDataFrame([(7, "2024-01-02"), (7, "2024-01-02"), (8, "2024-02-03"), (7, "2025-01-01")], "actor int, fecha string")
    months = {r["periodo"]: r["n"] for r in timeline.timeline(events, F.col("actor") == 7).collect()}
    assert months == {"2024-01": 2, "2024-02": 0, "2025-01": 1}
    detail = timeline.detail(events, F.col("actor") == 7, "2024-01").collect()
    assert [(r["fecha"], r["resumen"]) for r in detail] == [("2024-01-02", "2 intervenciones")]


SLUGS = [
    "/articulos/version-estenografica-conferencia-de-prensa-del-5-de-mayo-de-2026?x=1",
    "/articulos/version-estenografica-conferencia-de-prensa-del-5-de-foo-de-2026",
    "/articulos/version-estenografica-toma-de-protesta-del-1-de-octubre-de-2024",
    "/articulos/version-estenografica-conferencia-de-prensa-del-31-de-febrero-de-2025",
    "/articulos/version-estenografica-conferencia-de-prensa-del-30-de-septiembre-de-2024",
    "https://example.org/articulos/version-estenografica-conferencia-de-prensa-del-17-de-diciembre-de-2025",
    "/articulos/otra-cosa-del-3-de-enero-de-2026",
    "/sin-fecha",
]
STORED = [
    ("2025-01-01.txt", "u1", "2025-01-01", "whole", False, "x" * 600),
    ("2025-01-02.txt", "u2", "2025-01-02", "cut", True, "x" * 600),
    ("2025-01-03.txt", "u3", "2025-01-03", "cut", True, "x" * 600),
]
FETCHED = [
    ("b.txt", "v1", "2025-01-01", "still cut", True, "y" * 700),
    ("b.txt", "v2", "2025-01-02", "now whole", False, "y" * 700),
    ("b.txt", "v3", "2025-01-03", "too short", False, "y" * 10),
    ("b.txt", "v4", "2025-01-04", "first", False, "y" * 700),
    ("c.txt", "v5", "2025-01-04", "second", False, "y" * 700),
]


def test_archive_corners(spark):
    links = spark.createDataFrame([(1, i, x) for i, x in enumerate(SLUGS)], "page_id int, pos int, href string")
    found = pages.article_links(links, "https://example.org").collect()
    assert [(str(r["fecha"]), r["url"].rsplit("-del-", 1)[0].rsplit("/", 1)[1]) for r in found] == [
        ("2024-10-01", "version-estenografica-toma-de-protesta"),
        ("2025-12-17", "version-estenografica-conferencia-de-prensa"),
        ("2026-05-05", "version-estenografica-conferencia-de-prensa"),
    ]
    assert pages.latest_article(links, "https://example.org").first()["fecha"] == "2026-05-05"


def test_upsert_corners(spark):
    schema = "file string, url string, fecha string, titulo string, incompleto boolean, body string"
    old, new = (spark.createDataFrame(x, schema) for x in (STORED, FETCHED))
    found = {r["fecha"]: r["titulo"] for r in corpus.upsert(old, new).collect()}
    assert found == {"2025-01-01": "whole", "2025-01-02": "now whole", "2025-01-03": "cut", "2025-01-04": "second"}


def test_dates_of_selected_officials_only(spark):
    rows = [("SECRETARIO DE PAZ, ANA DÍAZ", "2025-01-02"), ("SECRETARIO DE PAZ, ANA DÍAZ", "2025-01-01"), ("TITULAR DE LUZ, EVA MAR", "2025-01-01"), ("TITULAR DE LUZ, EVA MAR", "2025-01-03"), ("TITULAR DE SOL, LUIS PAZ", "2025-01-01")]
    turns = spark.createDataFrame(rows, "hablante string, fecha string").withColumn("tipo", F.lit("funcionario"))
    resolved = actors.resolve(turns)
    found = actors.actor_dates(turns, resolved, actors.ranking(resolved, 1))
    # the secretary always, and the most frequent one (of two with equal turns the first by name)
    assert {r["nombre"] for r in found.collect()} == {"SECRETARIO DE PAZ, ANA DÍAZ"}
    assert actors.actor_dates(turns, resolved).count() == 5


def test_timelines_are_zero_filled(spark):
    rows = [("a", "2025-01-01"), ("a", "2025-01-01"), ("a", "2025-03-01"), ("b", "2025-02-01"), ("c", "")]
    events = spark.createDataFrame(rows, "actor string, fecha string")
    got = {(r["actor"], r["periodo"]): r["n"] for r in timeline.timelines(events).collect()}
    assert len(got) == 12 and {k: n for k, n in got.items() if n} == {("a", "2025-01"): 2, ("a", "2025-03"): 1, ("b", "2025-02"): 1, ("c", ""): 1}
    assert {r["n"] for r in timeline.timelines(events, "year", "conferences").where("actor = 'a' AND periodo = '2025'").collect()} == {2}
    assert timeline.timelines(events.limit(0)).collect() == []


def test_every_stored_page_is_that_of_the_offset(spark, tmp_path):
    turns = spark.createDataFrame([(f"c{i % 7}", f"2025-01-{1 + i % 5:02d}", i, "agua " * (i % 6)) for i in range(60)], "conv_id string, fecha string, turno int, texto string")
    found = kwic.hits(turns, "agua")
    kwic.store_pages(found, str(tmp_path / "p"), 5)
    rows = lambda frame: [(r["conv_id"], r["turno"], r["at"]) for r in frame.collect()]
    for number in range(12):
        assert rows(kwic.stored_page(spark, str(tmp_path / "p"), number)) == rows(kwic.page(found, number))
    plan = kwic.stored_page(spark, str(tmp_path / "p"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    kwic.store_pages(found.limit(0), str(tmp_path / "none"))


def test_marts_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "marts")
    table = lambda *values: spark.createDataFrame([(v,) for v in values], "x int")
    values = lambda: {name: sorted(r["x"] for r in t.collect()) for name, t in marts.published(spark, path).items()}
    assert marts.published(spark, path) == {}
    marts.publish({"a": table(1), "b": table(2), "old": table(9)}, path)
    reader = marts.published(spark, path)
    broken = table(3).select(F.raise_error(F.lit("killed midway")).cast("int").alias("x"))
    with pytest.raises(Exception, match="killed midway"):
        marts.publish({"a": table(4), "b": broken}, path)
    assert values() == {"a": [1], "b": [2], "old": [9]}
    marts.publish({"a": table(5), "b": table(6)}, path)
    assert values() == {"a": [5], "b": [6]}
    marts.publish({"a": table(7)}, path, form="json")
    assert values() == {"a": [7]} and len(list((tmp_path / "marts/versions").iterdir())) == 2
    with pytest.raises(Exception):
        reader["a"].collect()


def test_marks_of_any_letter_go(spark):
    import unicodedata

    words = ["áÉñü", "Ǻǖ", "ắộ", "ё й", "ώ", "n\u0303", "ßø", "日本", "İı"]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select(F.upper("w").alias("u"), T.strip_accents(F.col("w")).alias("x"))
    for r in frame.collect():
        assert r["x"] == "".join(c for c in unicodedata.normalize("NFD", r["u"]) if unicodedata.category(c) != "Mn")


def test_nested_elements(spark):
    html = "<body><article class=a>one <article>two</article> <!-- </article> --> three</article><article>four</article></body>"
    frame = spark.createDataFrame([(html,), ("<article>open <b>end",), ("<articles>x</articles>",), (None,)], "h string")
    assert [r["x"] for r in frame.select(pages.element_text(F.col("h"), "article").alias("x")).collect()] == ["one two three", "open end", "", None]


def test_topic_words_have_a_defined_order(spark):
    texts = ["uno dos tres", "uno dos tres", "uno dos tres", "uno dos tres", "uno dos tres"]
    frame = spark.createDataFrame([("2025-01-01", t) for t in texts], "fecha string, texto string")
    vectorizer, model, _ = topics.fit(frame, [], 2)
    for topic in (0, 1):
        rows = topics.labels(vectorizer, model, 3).where(F.col("topico") == topic).orderBy("rank").collect()
        weight = {w: model.topicsMatrix().toArray()[i, topic] for i, w in enumerate(vectorizer.vocabulary)}
        assert [r["termino"] for r in rows] == sorted(weight, key=lambda w: (-weight[w], w)) and [r["rank"] for r in rows] == [1, 2, 3]
