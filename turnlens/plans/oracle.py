"""DuckDB SQL that gives the rows of the queries, on the same tables."""

from __future__ import annotations

import re

from turnlens import vocab
from turnlens.functions import morphology as M
from turnlens.operators import topics
from turnlens.plans import fixtures
from turnlens.sources.bindings import LABELS

SQL_LETTERS = "[a-záéíóúüñ]"


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_str(v) for v in values) + "]"


def _values(rows, columns: str) -> str:
    def one(v):
        return {True: "true", False: "false"}.get(v) if isinstance(v, bool) else str(v) if isinstance(v, int) else _str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") v({columns})"


TURNS = f"""turns AS (
  SELECT conv_id, CAST(DATE '2024-10-02' + CAST((conv_id * 7) % 365 AS INTEGER) AS VARCHAR) AS fecha, turn AS turno,
    CASE role WHEN 'assistant' THEN 'presidenta' WHEN 'user' THEN 'pregunta' WHEN 'system' THEN 'funcionario' ELSE 'otro' END AS tipo,
    {_list(LABELS)}[((conv_id * 5 + turn) % {len(LABELS)}) + 1] AS hablante, text AS texto
  FROM conversations)"""
OFFICIAL = TURNS + ", oficial AS (SELECT * FROM turns WHERE tipo <> 'presidenta')"
EVENTS = "ev AS (SELECT user_id AS actor, CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, event_type AS categoria FROM events)"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
BY_DATE = f"""por AS (
  SELECT fecha, CAST(sum({WORDS.format("texto")}) AS BIGINT) AS total_words,
    CAST(coalesce(sum({WORDS.format("texto")}) FILTER (tipo = 'presidenta'), 0) AS BIGINT) AS presidenta_words,
    count(*) FILTER (tipo = 'presidenta') AS presidenta_turns, count(*) FILTER (tipo = 'pregunta') AS pregunta_turns,
    count(*) FILTER (tipo = 'funcionario') AS funcionario_turns,
    count(*) FILTER (tipo NOT IN ('presidenta', 'pregunta', 'funcionario')) AS otro_turns
  FROM turns GROUP BY fecha)"""
VOICE = f"""n AS (SELECT substr(fecha, 1, 7) AS mes, tipo, sum({WORDS.format("texto")}) AS n FROM turns GROUP BY ALL),
  t AS (SELECT *, sum(n) OVER (PARTITION BY mes) AS total FROM n),
  voz AS (SELECT mes, tipo, round(n * 100.0::DOUBLE / total, 1) AS pct FROM t WHERE total > 0)"""


def _tokens(text: str, size: str = "{3,}") -> str:
    return f"regexp_extract_all(lower({text}), '{SQL_LETTERS}{size}')"


def _framing(frames: dict) -> str:
    cases = " UNION ALL ".join(f"SELECT {_str(f)} AS frame, unnest({_list(v)}) AS term" for f, v in frames.items())
    names = ", ".join(f"({_str(f)})" for f in frames)
    return f"""WITH {TURNS}, lex AS ({cases}),
  s AS (SELECT 'total' AS scope, * FROM turns UNION ALL SELECT 'presidenta', * FROM turns WHERE tipo = 'presidenta'),
  tok AS (SELECT scope, substr(fecha, 1, 7) AS mes, unnest({_tokens("texto", "+")}) AS term FROM s),
  tot AS (SELECT scope, mes, count(*) AS total FROM tok GROUP BY ALL),
  hit AS (SELECT scope, mes, frame, count(*) AS hits FROM tok JOIN lex USING (term) GROUP BY ALL),
  fr AS (SELECT scope, mes, frame, coalesce(hits, 0) AS hits, total, round(coalesce(hits, 0) * 1000.0::DOUBLE / total, 3) AS por_mil
    FROM tot CROSS JOIN (VALUES {names}) f(frame) LEFT JOIN hit USING (scope, mes, frame))"""


def _pivot(source: str, key: str, column: str, value: str, names, fill: str | None = None) -> str:
    cell = lambda n: f"max({value}) FILTER ({column} = {_str(n)})"
    cells = ", ".join(f"coalesce({cell(n)}, {fill}) AS {n}" if fill else f"{cell(n)} AS {n}" for n in names)
    return f"SELECT {key}, {cells} FROM {source} GROUP BY {key}"


def _topk(source: str, group: str, text: str, stops) -> str:
    return f"""tok AS (SELECT {group} AS grp, unnest({_tokens(text)}) AS term FROM {source}),
  c AS (SELECT grp, term, count(*) AS n FROM tok WHERE NOT list_contains({_list(stops)}, term) GROUP BY ALL),
  r AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS INTEGER) AS rank, term, n FROM c)
  SELECT * FROM r WHERE rank <= 50"""


def _tagged() -> str:
    """CTEs ending in tagged(conv_id, turno, fecha, tipo, sentence, pos, word, lemma, tag): the path of least cost, place after place, and back."""
    k = {tag: i for i, tag in enumerate(M.TAGS)}
    lex = [(w, k[t], lemma, cost) for w, found in M.lexicon().items() for t, (lemma, cost) in found.items()]
    end = [(e, k[t], lemma, cost) for e, found in M.endings().items() for t, (lemma, cost) in found.items()]
    after = [(a, b, c) for a, row in enumerate(M.AFTER) for b, c in enumerate(row)]
    split = M.SENTENCE_ENDS.replace("\n", "\\n")
    return f"""WITH RECURSIVE {TURNS},
  lx AS (SELECT * FROM {_values(lex, "w, t, lemma, cost")}), en AS (SELECT * FROM {_values(end, "e, t, lemma, cost")}),
  af AS (SELECT * FROM {_values(after, "t, u, cost")}), st AS (SELECT * FROM {_values(list(enumerate(M.START)), "t, cost")}), fi AS (SELECT * FROM {_values(list(enumerate(M.END)), "t, cost")}),
  s0 AS (SELECT conv_id, turno, fecha, tipo, list_filter(list_transform(regexp_split_to_array(texto, '{split}'), lambda x: regexp_extract_all(x, '{M.WORD}')), lambda x: len(x) > 0) AS p FROM turns),
  s1 AS (SELECT conv_id, turno, fecha, tipo, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS sentence FROM s0),
  s2 AS (SELECT row_number() OVER () AS id, * FROM s1),
  wd AS (SELECT id, conv_id, turno, fecha, tipo, sentence, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM s2),
  vo AS (SELECT DISTINCT lower(word) AS w FROM wd),
  ru AS (SELECT w, t, left(w, length(w) - length(e)) || en.lemma AS lemma, cost, row_number() OVER (PARTITION BY w, t ORDER BY length(e) DESC) AS r
    FROM vo JOIN en ON ends_with(w, e) AND length(e) <= greatest(length(w) - {M.LEAST_STEM}, 0) WHERE w NOT IN (SELECT w FROM lx)),
  an AS (SELECT w, t, lemma, cost FROM ru WHERE r = 1 UNION ALL SELECT lx.* FROM lx JOIN vo USING (w)),
  ca AS (SELECT *, pos > 0 AND regexp_matches(word, '^[A-ZÁÉÍÓÚÜÑ]') AND lower(word) NOT IN (SELECT w FROM lx) AS name FROM wd),
  em AS (SELECT id, pos, t, an.cost + CASE WHEN name THEN {M.CAPITAL} ELSE 0 END AS cost FROM ca JOIN an ON an.w = lower(word) WHERE NOT (name AND t = {k["PROPN"]})
    UNION ALL SELECT id, pos, {k["PROPN"]}, 0 FROM ca WHERE name),
  vi AS (SELECT id, pos, em.t, CAST(em.cost + st.cost AS BIGINT) AS score, CAST(NULL AS BIGINT) AS prev FROM em JOIN st USING (t) WHERE pos = 0
    UNION ALL SELECT em.id, em.pos, em.t, CAST(min(vi.score + af.cost) + any_value(em.cost) AS BIGINT), CAST(min((vi.score + af.cost) * 16 + vi.t) % 16 AS BIGINT)
      FROM vi JOIN em ON em.id = vi.id AND em.pos = vi.pos + 1 JOIN af ON af.t = vi.t AND af.u = em.t GROUP BY em.id, em.pos, em.t),
  la AS (SELECT vi.id, vi.pos, arg_min(vi.t, (vi.score + fi.cost) * 16 + vi.t) AS t FROM vi JOIN fi USING (t) JOIN (SELECT DISTINCT id, n FROM wd) USING (id) WHERE vi.pos = n - 1 GROUP BY ALL),
  ba AS (SELECT la.id, la.pos, la.t, prev FROM la JOIN vi USING (id, pos, t)
    UNION ALL SELECT vi.id, vi.pos, vi.t, vi.prev FROM ba JOIN vi ON vi.id = ba.id AND vi.pos = ba.pos - 1 AND vi.t = ba.prev),
  tagged AS (SELECT conv_id, turno, fecha, tipo, CAST(sentence AS INTEGER) AS sentence, CAST(pos AS INTEGER) AS pos, word, coalesce(an.lemma, lower(word)) AS lemma,
      {_list(M.TAGS)}[ba.t + 1] AS tag FROM wd JOIN ba USING (id, pos) LEFT JOIN an ON an.w = lower(word) AND an.t = ba.t)"""


def _top_lemmas(group: str, stops, tipo: str | None = None) -> str:
    own = f"AND tipo = {_str(tipo)}" if tipo else ""
    return f"""c AS (SELECT {group} AS grp, lemma AS term, count(*) AS n FROM tagged WHERE tag IN ({_list(M.CONTENT)[1:-1]}) AND length(lemma) > 2 {own}
    AND NOT list_contains({_list(stops)}, lemma) AND NOT list_contains({_list(stops)}, lower(word)) GROUP BY ALL),
  r AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS INTEGER) AS rank, term, n FROM c)
  SELECT * FROM r WHERE rank <= 50"""


def _digest(stops) -> str:
    keep = f"NOT list_contains({_list(stops)}, {{0}})"
    return f"""WITH es AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
  w AS (SELECT doc_id, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM es),
  g AS (SELECT doc_id, a AS term FROM w WHERE {keep.format("a")}
    UNION ALL SELECT doc_id, a || ' ' || b FROM w WHERE b IS NOT NULL AND {keep.format("a")} AND {keep.format("b")}),
  df AS (SELECT term, count(DISTINCT doc_id) AS df FROM g GROUP BY term),
  own AS (SELECT term, count(*) AS n FROM g WHERE doc_id = (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 1) GROUP BY term),
  sc AS (SELECT term, n, df, round(n * ln(CAST((SELECT count(*) FROM es) AS DOUBLE) / df) * CASE WHEN contains(term, ' ') THEN 1.4 ELSE 1.0 END, 6) AS score
    FROM own JOIN df USING (term) WHERE n >= CASE WHEN contains(term, ' ') THEN 2 ELSE 4 END),
  ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, length(term) DESC, term) AS INTEGER) AS rank, term, n, df, CAST(score AS DOUBLE) AS score FROM sc)"""


def _phrase_tiles(term: str) -> str:
    """The tile at hand and as many after it as a phrase's words and gaps take, joined."""
    n = len(re.findall(f"{SQL_LETTERS}+|[^a-záéíóúüñ]+", term))
    return " || ".join(["s", *[f"coalesce(lead(s, {k}) OVER (PARTITION BY conv_id, turno ORDER BY i), '')" for k in range(1, n)]])


def _kwic(term: str) -> str:
    return f"""WITH RECURSIVE {TURNS}, p AS (SELECT * FROM turns WHERE tipo = 'presidenta' AND contains(lower(texto), {_str(term)})),
  tile AS (SELECT conv_id, fecha, turno, texto, unnest(x) AS s, generate_subscripts(x, 1) AS i
    FROM (SELECT *, regexp_extract_all(lower(texto), '{SQL_LETTERS}+|[^a-záéíóúüñ]+') AS x FROM p)),
  pos AS (SELECT *, CAST(sum(length(s)) OVER (PARTITION BY conv_id, turno ORDER BY i) - length(s) AS INTEGER) AS "at" FROM tile),
  nxt AS (SELECT *, {_phrase_tiles(term)} AS run FROM pos),
  hit AS (SELECT conv_id, fecha, turno, texto, "at", greatest(0, "at" - 120) AS lo, least(length(texto), "at" + {len(term)} + 120) AS hi FROM nxt WHERE run = {_str(term)}),
  ctx AS (SELECT *, CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(texto, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) || CASE WHEN hi < length(texto) THEN '…' ELSE '' END AS ctx FROM hit)"""


# --- names ----------------------------------------------------------------------

_UP = "strip_accents(upper({0}))"
_STEM = "|".join(vocab.ROLE_STEMS)
_SEG = "list_filter(list_transform(string_split({0}, ','), lambda s: trim(s)), lambda s: s <> '')"
_NORM = r"trim(regexp_replace({0}, '\s*\([^)]*\)\s*$', ''))"


def _names(source: str, column: str) -> str:
    """CTEs ending in nm(lbl, nombre, cargo, categoria, estado, persona, clave, toks) for the distinct normalised labels."""
    return f"""nm0 AS (SELECT DISTINCT {_NORM.format(column)} AS lbl FROM {source}),
  nm1 AS (SELECT lbl, {_UP.format("lbl")} AS u, {_SEG.format("lbl")} AS segs FROM nm0),
  nm2 AS (SELECT *, segs[1] AS a, segs[-1] AS z, regexp_matches({_UP.format("segs[1]")}, '^(?:{_STEM})') AS rf FROM nm1),
  nm3 AS (SELECT *, CASE WHEN rf THEN z ELSE a END AS c, CASE WHEN rf THEN a ELSE z END AS o FROM nm2),
  nm4 AS (SELECT *, CASE WHEN len(segs) <= 1 THEN a
      WHEN regexp_matches({_UP.format("c")}, '{_STEM}') AND NOT regexp_matches({_UP.format("o")}, '{_STEM}') THEN o ELSE c END AS nombre FROM nm3),
  nm5 AS (SELECT *, coalesce(nullif(array_to_string(list_filter(segs, lambda s: s <> nombre), ', '), ''), lbl) AS cargo,
    CASE WHEN regexp_matches(u, 'JEF[EA] DE GOBIERNO') THEN 'CIUDAD DE MEXICO'
      ELSE list_filter({_list(vocab.STATES)}, lambda e: contains(u, e))[1] END AS estado,
    list_filter(string_split({_UP.format("nombre")}, ' '), lambda t: t <> '' AND NOT list_contains({_list([*vocab.PARTICLES, *vocab.HONORIFICS])}, t)) AS toks FROM nm4),
  nm6 AS (SELECT *, CASE WHEN regexp_matches(u, 'GOBERNADOR|JEF[EA] DE GOBIERNO') THEN 'gobernadores' WHEN contains(u, 'DIRECTOR') THEN 'directores'
      WHEN contains(u, 'SECRETARI') AND NOT (regexp_matches(u, 'SINDICATO|CONFEDERACION|SECRETARI[OA] GENERAL|ESTADOS UNIDOS DE AMERICA') OR estado IS NOT NULL)
      THEN 'secretarios' ELSE 'otros' END AS categoria,
    CASE WHEN len(toks) = 0 THEN u ELSE array_to_string(toks[greatest(len(toks) - 1, 1):], '|') END AS persona FROM nm5),
  nm AS (SELECT *, CASE WHEN categoria = 'gobernadores' AND estado IS NOT NULL THEN 'GOB::' || estado ELSE persona END AS clave FROM nm6)"""


_VARIANTS = f"""{OFFICIAL}, {_names("oficial", "hablante")},
  vr AS (SELECT {_NORM.format("hablante")} AS variante, count(*) AS n FROM oficial GROUP BY 1),
  va AS (SELECT variante, n, clave FROM vr JOIN nm ON lbl = variante)"""
_GROUPS = f"""{_VARIANTS},
  gr0 AS (SELECT clave, min_by(variante, (-n, variante)) AS canon, sum(n) AS total FROM va GROUP BY clave),
  gr AS (SELECT gr0.clave, canon, total, categoria, toks, nombre FROM gr0 JOIN nm ON lbl = canon),
  ed AS (SELECT x.clave AS a, y.clave AS b FROM gr x JOIN gr y ON x.categoria = y.categoria AND x.toks[1] = y.toks[1] AND x.clave < y.clave
    WHERE least(len(list_distinct(x.toks)), len(list_distinct(y.toks))) >= 2
      AND len(list_intersect(list_distinct(x.toks), list_distinct(y.toks))) = least(len(list_distinct(x.toks)), len(list_distinct(y.toks)))),
  both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed UNION SELECT clave, clave FROM gr),
  reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
  cc AS (SELECT a AS clave, min(b) AS grupo FROM reach GROUP BY a)"""


def _participants(n: str) -> str:
    return f"""WITH {_VARIANTS}, m AS (SELECT clave, min_by(variante, (-n, variante)) AS canon, CAST(sum({n}) AS BIGINT) AS intervenciones FROM va GROUP BY clave)
  SELECT nombre, cargo, categoria, intervenciones FROM m JOIN nm ON lbl = canon"""


_ROLE_WORDS = "list_distinct(list_filter(string_split(replace({0}, ',', ''), ' '), lambda t: t <> '' AND NOT list_contains(" + _list(vocab.PARTICLES) + ", t)))"


def _office(people: str) -> str:
    """CTEs ending in om(clave, titular, score); people has clave, canon and total."""
    return f"""pe AS (SELECT g.clave, g.canon, g.total, nm.categoria, nm.nombre, nm.u FROM {people} g JOIN nm ON nm.lbl = g.canon),
  lone AS (SELECT clave, categoria, {_ROLE_WORDS.format("u")} AS own FROM pe WHERE regexp_matches({_UP.format("nombre")}, '{_STEM}')),
  holder AS (SELECT clave AS titular, total, canon, categoria,
      list_filter({_ROLE_WORDS.format("u")}, lambda w: NOT list_contains({_ROLE_WORDS.format(_UP.format("nombre"))}, w)) AS rl
    FROM pe WHERE NOT regexp_matches({_UP.format("nombre")}, '{_STEM}')),
  sc AS (SELECT clave, titular, total, canon, CAST(len(list_intersect(own, rl)) AS DOUBLE) / len(rl) AS score
    FROM lone JOIN holder USING (categoria) WHERE len(rl) > 0),
  om AS (SELECT clave, titular, round(score, 4) AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY score DESC, total DESC, canon) AS r FROM sc WHERE score >= 0.6) WHERE r = 1)"""


_RESOLVED = f"""{_GROUPS}, fi AS (SELECT variante, n, grupo AS clave FROM va JOIN cc USING (clave)),
  g2 AS (SELECT clave, min_by(variante, (-n, variante)) AS canon, sum(n) AS total FROM fi GROUP BY clave), {_office("g2")},
  fn AS (SELECT variante, n, coalesce(titular, fi.clave) AS clave FROM fi LEFT JOIN om USING (clave)),
  ca AS (SELECT clave, min_by(variante, (-n, variante)) AS nombre FROM fn GROUP BY clave),
  rs AS (SELECT variante, n, ca.nombre FROM fn JOIN ca USING (clave))"""

_SPEAKER = r"^([A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑ0-9\s,.\-()]+?)\s*:\s+(.*)"


def _type(x: str) -> str:
    return f"""CASE WHEN contains({x}, 'PRESIDENTA') AND contains({x}, 'SHEINBAUM') THEN 'presidenta' WHEN {x} = 'PREGUNTA' THEN 'pregunta'
    WHEN starts_with({x}, 'INTERVENCIÓN') OR starts_with({x}, 'VOZ ') THEN 'otro'
    WHEN regexp_matches({x}, '{"|".join(vocab.ROLE_WORDS)}') THEN 'funcionario' ELSE 'otro' END"""


LABELLED = f"{TURNS}, lb AS (SELECT conv_id, fecha, turno, {_list(fixtures.LABELS)}[((conv_id * 5 + turno) % {len(fixtures.LABELS)}) + 1] AS label, texto FROM turns)"
_FILES = f"""{LABELLED},
  sd AS (SELECT conv_id, fecha, string_agg(CASE WHEN conv_id % 7 = 0 AND turno = 2 THEN '—000—' || chr(10) ELSE '' END || label || coalesce(': ' || texto, ''), chr(10) ORDER BY turno) AS body
    FROM lb GROUP BY ALL),
  f AS (SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') || '.txt' AS file, 'URL: https://example.org/a/' || conv_id || chr(10) || 'Fecha: ' || fecha || chr(10) || 'Título: Conversación ' ||
    conv_id || chr(10) || chr(10) || body || CASE WHEN conv_id % 5 = 0 THEN chr(10) || '(CONTINÚA…)' ELSE '' END AS value FROM sd), ln AS (SELECT file, value, string_split(regexp_replace(value, '\n$', ''), chr(10)) AS l FROM f)"""


def _head(name: str, among: int = 5) -> str:
    return f"coalesce(trim(substr(list_filter(l[1:{among}], lambda s: starts_with(s, {_str(name)}))[-1], {len(name) + 1})), '')"


_SLUG = r"del-(\d{1,2})-de-(\w+)-de-(\d{4})"
_SLUG_TEXT = f"""CASE WHEN NOT regexp_matches(url, '{_SLUG}') THEN '' ELSE regexp_extract(url, '{_SLUG}', 3) || '-' ||
  lpad(CAST(coalesce(list_position({_list(vocab.MONTHS)}, lower(regexp_extract(url, '{_SLUG}', 2))), 0) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(url, '{_SLUG}', 1), 2, '0') END"""
_DATED = f"'del-' || day(dd) || '-de-' || {{0}} || '-de-' || year(dd)"
_SPOKEN_MONTH = f"{_list(vocab.MONTHS)}[month(dd)]"
_PRESS = "'/articulos/version-estenografica-conferencia-de-prensa-' || "
_SLUGS = f"""sl AS (SELECT conv_id AS page_id, turno AS pos, CASE conv_id % 5 WHEN 0 THEN '/articulos/version-estenografica-toma-de-protesta-' || {_DATED.format(_SPOKEN_MONTH)}
  WHEN 1 THEN 'https://example.org' || {_PRESS}{_DATED.format(_SPOKEN_MONTH)} WHEN 2 THEN {_PRESS}{_DATED.format("'foo'")}
  WHEN 3 THEN {_PRESS}{_DATED.format(_SPOKEN_MONTH)} || '?x=1' ELSE '/articulos/otra-cosa-' || {_DATED.format(_SPOKEN_MONTH)} END AS href
  FROM (SELECT *, CAST(fecha AS DATE) AS dd FROM turns))"""
_ABSOLUTE = "CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.org' || href END"


def _inner(tag: str) -> str:
    # an element that is never closed takes the rest of the page
    inner = f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)(?:</{tag}\\s*>|$)', 1)"
    text = f"regexp_replace(regexp_replace(regexp_replace({inner}, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]*>', ' ', 'g')"
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{code}', '{plain}')"
    return f"trim(regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g'))"


_CLEAN = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10))"
_FROM_LINKS = r"""hr AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS h FROM pages),
  lk AS (SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href FROM hr)"""
_ENC = "url_encode({0})"
for _code, _plain in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
    _ENC = f"replace({_ENC}, '{_code}', '{_plain}')"


def _meta(kind: str) -> str:
    name = {"name": "date", "property": "article:published_time"}[kind]
    return rf"""regexp_extract(html, '(?i)<meta\s[^>]*?{kind}=["'']{name}["''][^>]*?content=["'']([^"'']*)["'']', 1)"""


def _given_topics(frames: dict) -> str:
    """CTEs ending in dia(fecha, topico, peso): shares of given topics, step by step."""
    words, rows = topics.matrix(frames)
    table = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in rows) + "]"
    ks, ws, k = f"range(1, {len(rows) + 1})", f"range(1, {len(words) + 1})", len(rows)
    return f"""WITH RECURSIVE {TURNS}, tk AS (SELECT conv_id, turno, fecha, {_tokens("texto", "+")} AS t FROM turns WHERE tipo = 'presidenta'),
  cn AS (SELECT *, {table} AS b, list_transform({_list(words)}, lambda w: CAST(len(list_filter(t, lambda x: x = w)) AS DOUBLE)) AS n FROM tk),
  em AS (SELECT conv_id, turno, fecha, b, n, list_sum(n) AS total, 0 AS i, [{", ".join([f"{1.0 / k!r}::DOUBLE"] * k)}] AS th FROM cn
    UNION ALL SELECT conv_id, turno, fecha, b, n, total, i + 1, list_transform({ks}, lambda k: (th[k] * list_sum(list_transform({ws}, lambda w: n[w] / de[w] * b[k][w])) + {topics.PRIOR}::DOUBLE) / (total + {k * topics.PRIOR!r}::DOUBLE))
      FROM (SELECT *, list_transform({ws}, lambda w: list_sum(list_transform({ks}, lambda k: th[k] * b[k][w]))) AS de FROM em WHERE i < {topics.STEPS})),
  lo AS (SELECT fecha, unnest(th) AS p, generate_subscripts(th, 1) - 1 AS topico FROM em WHERE i = {topics.STEPS}),
  dia AS (SELECT fecha, CAST(topico AS INTEGER) AS topico, round(avg(p), 4) AS peso FROM lo GROUP BY 1, 2)"""


def _timelines(period: str, n: str) -> str:
    return f"""WITH {EVENTS}, sp AS (SELECT DISTINCT {period} AS periodo FROM ev), ac AS (SELECT DISTINCT actor FROM ev),
  c AS (SELECT actor, {period} AS periodo, {n} AS n FROM ev GROUP BY ALL) SELECT actor, periodo, coalesce(n, 0) AS n FROM ac CROSS JOIN sp LEFT JOIN c USING (actor, periodo)"""


#: CTEs with the pages pg(archive, page, ok, n), their links ln(archive, page, pos, url, d), and rs and sp, in which scans stop.
_ARCHIVE = f"""pg AS (SELECT conv_id // 10 AS archive, conv_id % 10 * 8 + turn + 1 AS page, NOT (((conv_id // 10) % 4 = 1 AND conv_id % 10 * 8 + turn + 1 BETWEEN 17 AND 30) OR (conv_id % 10 * 8 + turn + 1) % 13 = 5) AS ok,
    CASE WHEN (conv_id // 10) % 4 = 2 AND conv_id % 10 * 8 + turn + 1 > 45 THEN 0 ELSE 1 + (conv_id % 10 * 8 + turn + 1) % 3 END AS n FROM conversations),
  ar AS (SELECT archive, page, unnest(range(0, n)) AS pos FROM pg WHERE ok),
  dy AS (SELECT *, DATE '2026-06-01' - CAST(page * CASE archive % 4 WHEN 0 THEN 12 WHEN 2 THEN 5 ELSE 3 END AS INTEGER) - CAST(pos AS INTEGER) AS d FROM ar),
  ln AS (SELECT archive, page, pos, d, 'https://example.org/articulos/' || CASE WHEN (page + pos) % 5 = 4 THEN 'version-estenografica-toma-de-protesta' ELSE 'version-estenografica-conferencia-de-prensa' END ||
    '-del-' || day(d) || '-de-' || {_list(vocab.MONTHS)}[month(d)] || '-de-' || year(d) AS url FROM dy WHERE NOT (archive % 4 = 3 AND page > 60)),
  pl AS (SELECT archive, page, min(d) AS lo, max(d) AS hi FROM ln GROUP BY ALL),
  ru AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY page) - row_number() OVER (PARTITION BY archive, ok ORDER BY page) AS run FROM pg WHERE page <= 200),
  rn AS (SELECT *, row_number() OVER (PARTITION BY archive, ok, run ORDER BY page) AS i FROM ru),
  rs AS (SELECT rn.archive, rn.page, ok, CASE WHEN NOT ok AND i >= 5 THEN 'sin respuesta' WHEN NOT ok THEN NULL WHEN n = 0 THEN 'sin artículos' WHEN lo < DATE '2024-10-01' THEN 'anteriores'
    WHEN NOT coalesce(hi >= DATE '2024-10-01', false) AND rn.page > 1 THEN 'sin resultados' END AS motivo FROM rn LEFT JOIN pl ON pl.archive = rn.archive AND pl.page = rn.page),
  sp AS (SELECT archive, min(page) FILTER (motivo IS NOT NULL) AS parada FROM rs GROUP BY archive)"""


def build(lexical: list[str], digest: list[str], frames: dict, term: str, phrase: str) -> dict[str, str]:
    """Name to SQL."""
    k = _kwic(term)
    size = len(term)
    w = r"regexp_split_to_array(frase, '\s+')"
    return {
        "corpus_stats_by_date": f"WITH {TURNS}, {BY_DATE} SELECT * FROM por",
        "corpus_overview": f"""WITH {TURNS}, {BY_DATE} SELECT array_to_string(list_sort(list(DISTINCT substr(fecha, 1, 7))), ',') AS meses,
            min(nullif(fecha, '')) AS fecha_inicio, max(nullif(fecha, '')) AS fecha_fin, count(*) AS total_conferencias,
            CAST(sum(presidenta_turns) AS BIGINT) AS total_turnos FROM por""",
        "turns_by_type": f"WITH {TURNS} SELECT tipo, count(*) AS n FROM turns GROUP BY tipo",
        "voice_share_monthly": f"WITH {TURNS}, {VOICE} SELECT * FROM voz",
        "voice_share_pivot": f"WITH {TURNS}, {VOICE} " + _pivot("voz", "mes", "tipo", "pct", ["presidenta", "pregunta", "funcionario", "otro"], "0.0"),
        "framing_monthly": _framing(frames) + " SELECT * FROM fr",
        "framing_lexicons": _framing(vocab.FRAMES) + " SELECT * FROM fr",
        "framing_pivot": _framing(frames) + " " + _pivot("fr", "scope, mes", "frame", "por_mil", list(frames)),
        "term_freq_topk": f"WITH {TURNS}, pr AS (SELECT * FROM turns WHERE tipo = 'presidenta'), " + _topk("pr", "substr(fecha, 1, 7)", "texto", lexical),
        "tagged_words": f"{_tagged()} SELECT conv_id, turno, sentence, pos, word, lemma, tag FROM tagged",
        "term_freq_lemmas": f"{_tagged()}, {_top_lemmas('tipo', lexical)}",
        "word_freq_monthly": f"{_tagged()}, {_top_lemmas('substr(fecha, 1, 7)', lexical, 'presidenta')}",
        "term_freq_by_source": "WITH " + _topk("documents", "source", "text", lexical),
        "tfidf_topk": f"""WITH {TURNS}, doc AS (SELECT substr(fecha, 1, 7) AS grp, list_filter({_tokens("string_agg(texto, ' ' ORDER BY fecha, conv_id, turno)")},
              lambda t: NOT list_contains({_list(lexical)}, t)) AS t FROM turns WHERE tipo = 'presidenta' GROUP BY 1),
            w AS (SELECT grp, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM doc),
            g AS (SELECT grp, a AS term FROM w UNION ALL SELECT grp, a || ' ' || b FROM w WHERE b IS NOT NULL),
            tf AS (SELECT grp, term, count(*) AS tf FROM g GROUP BY ALL),
            v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 5000),
            x AS (SELECT grp, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM doc)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN v USING (term)),
            s AS (SELECT grp, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY grp)), 4) AS score FROM x),
            r AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM s)
            SELECT * FROM r WHERE rank <= 20 AND score > 0""",
        "digest_terms": _digest(digest) + " SELECT * FROM ranked",
        "digest_pick": _digest(digest).replace("WITH es", "WITH RECURSIVE es", 1)
        + """, pk(i, ch) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL SELECT i + 1, CASE WHEN len(ch) < 6
              AND len(list_filter(ch, lambda e: contains(e, r.term) OR contains(r.term, e))) = 0 THEN list_append(ch, r.term) ELSE ch END
              FROM pk JOIN ranked r ON r.rank = i + 1),
            fin AS (SELECT ch FROM pk ORDER BY i DESC LIMIT 1), u AS (SELECT unnest(ch) AS t, generate_subscripts(ch, 1) AS p FROM fin)
            SELECT CAST(p - 1 AS INTEGER) AS pos, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS termino FROM u""",
        "token_counts": f"""SELECT doc_id, CAST({WORDS.format("text")} AS BIGINT) AS n_words, CAST(len({_tokens("text", "+")}) AS BIGINT) AS n_letters,
            CAST(len({_tokens("text")}) AS BIGINT) AS n_letters3, CAST(greatest(len({_tokens("text")}) - 1, 0) AS BIGINT) AS n_bigrams FROM documents""",
        "kwic_trend": f"""WITH {TURNS}, p AS (SELECT substr(fecha, 1, 7) AS mes, {_tokens("texto", "+")} AS t FROM turns WHERE tipo = 'presidenta')
            SELECT mes, CAST(sum(len(list_filter(t, lambda x: x = {_str(term)}))) AS BIGINT) AS n FROM p GROUP BY mes""",
        "kwic_indexed": f'{_kwic(term)} SELECT conv_id, fecha, turno, "at", ctx FROM ctx',
        "kwic_indexed_phrase": f'{_kwic(phrase)} SELECT conv_id, fecha, turno, "at", ctx FROM ctx',
        "kwic_context": k + ' SELECT conv_id, fecha, turno, "at", ctx FROM ctx',
        "kwic_page": k + ' SELECT conv_id, fecha, turno, "at", ctx FROM ctx ORDER BY fecha DESC, conv_id, turno, "at" LIMIT 15 OFFSET 15',
        "kwic_stored_page": k + ' SELECT conv_id, fecha, turno, "at", ctx FROM ctx ORDER BY fecha DESC, conv_id, turno, "at" LIMIT 15 OFFSET 15',
        "kwic_links": k
        + f""", fr AS (SELECT *, trim(regexp_extract(left(texto, "at"), '[^.?!…]*$') || substr(texto, "at" + 1, {size}) ||
              regexp_extract(substr(texto, "at" + {size + 1}), '^[^.?!…]*[.?!…]?'), ' ' || chr(10) || chr(9) || chr(13)) AS frase,
              CASE WHEN day(CAST(fecha AS DATE)) % 3 <> 0 THEN 'https://example.org/a/' || fecha END AS url FROM ctx)
            SELECT conv_id, turno, "at", frase, CASE WHEN frase = '' THEN url WHEN length(frase) <= 160 OR len({w}) <= 12
              THEN url || '#:~:text=' || {_ENC.format("frase")}
              ELSE url || '#:~:text=' || {_ENC.format(f"array_to_string({w}[1:8], ' ')")} || ',' || {_ENC.format(f"array_to_string({w}[-6:], ' ')")} END AS link FROM fr""",
        "kwic_highlight": k
        + f""" SELECT conv_id, turno, "at", array_to_string(list_transform(regexp_extract_all(ctx, '(?i:{SQL_LETTERS}+)|[^a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+'),
              lambda s: CASE WHEN lower(s) = {_str(term)} THEN '<mark>' || s || '</mark>' ELSE s END), '') AS marked FROM ctx""",
        "participants": _participants("n"),
        "participants_compat": _participants("n * n"),
        "question_count": f"WITH {TURNS} SELECT count(*) FILTER (tipo = 'pregunta') AS n_preguntas FROM turns",
        "actor_timeline_month": _timelines("substr(fecha, 1, 7)", "count(*)"),
        "actor_timeline_day": f"WITH {EVENTS} SELECT fecha AS periodo, count(*) AS n FROM ev GROUP BY ALL",
        "actor_timeline_conferences": _timelines("substr(fecha, 1, 4)", "count(DISTINCT fecha)"),
        "actor_period_detail": f"""WITH {EVENTS} SELECT fecha, count(*) AS n, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' intervención' ELSE ' intervenciones' END AS resumen
            FROM ev WHERE substr(fecha, 1, 4) = '2024' GROUP BY fecha""",
        "category_aggregate": f"WITH {EVENTS} SELECT categoria, count(DISTINCT actor) AS actores, count(*) AS eventos FROM ev GROUP BY categoria",
        "category_timeline": f"WITH {EVENTS} SELECT categoria, fecha AS periodo, count(*) AS n, count(DISTINCT actor) AS actores FROM ev GROUP BY ALL",
        **{
            name: f"WITH {LABELLED}, {_names('lb', 'label')} SELECT conv_id, turno, {what} FROM lb JOIN nm ON lbl = {on}"
            for name, what, on in (
                (
                    "name_split",
                    """label, nombre, cargo, CASE WHEN contains(label, ',') THEN trim(split_part(label, ',', 1)) ELSE '' END AS cargo_vista,
                    CASE WHEN contains(label, ',') THEN trim(substr(label, strpos(label, ',') + 1)) ELSE trim(label) END AS nombre_vista""",
                    _NORM.format("label"),
                ),
                ("merge_key", "label, estado, persona, clave", _NORM.format("label")),
            )
        },
        "speaker_classify": f"""WITH {LABELLED}, l2 AS (SELECT conv_id, turno, label, {_UP.format("label")} AS u FROM lb)
            SELECT conv_id, turno, label, {_type("label")} AS tipo, CASE WHEN regexp_matches(u, 'GOBERNADOR|JEF[EA] DE GOBIERNO') THEN 'gobernadores' WHEN contains(u, 'DIRECTOR') THEN 'directores'
              WHEN contains(u, 'SECRETARI') AND NOT regexp_matches(u, 'SINDICATO|CONFEDERACION|SECRETARI[OA] GENERAL|ESTADOS UNIDOS DE AMERICA|{"|".join(vocab.STATES)}') THEN 'secretarios'
              ELSE 'otros' END AS categoria FROM l2""",
        "entity_groups": f"WITH RECURSIVE {_GROUPS} SELECT clave, grupo FROM cc",
        "office_match": f"WITH RECURSIVE {_GROUPS}, {_office('gr0')} SELECT clave, titular, score FROM om",
        "officials_ranking": f"""WITH RECURSIVE {_RESOLVED}, t AS (SELECT rs.nombre, CAST(sum(n) AS BIGINT) AS apariciones, any_value(nm.categoria) AS categoria FROM rs JOIN nm ON nm.lbl = rs.nombre GROUP BY 1),
            top AS (SELECT * FROM t ORDER BY apariciones DESC, nombre LIMIT 100)
            SELECT * FROM t WHERE categoria IN ('gobernadores', 'secretarios') UNION SELECT * FROM top""",
        "official_dates": f"""WITH RECURSIVE {_RESOLVED} SELECT rs.nombre, count(*) AS turnos, count(DISTINCT fecha) AS fechas
            FROM oficial JOIN rs ON rs.variante = {_NORM.format("hablante")} GROUP BY 1""",
        "turn_segmentation": f"""WITH {_FILES}, x AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM ln),
            y AS (SELECT file, pos, trim(line) AS line FROM x WHERE pos > 3 AND trim(line) <> ''),
            z AS (SELECT *, max(CAST(line = '—000—' AS INTEGER)) OVER (PARTITION BY file ORDER BY pos) AS over,
              CASE WHEN NOT regexp_matches(line, '^\\(.*\\)$|^—.*—$') AND length(trim(regexp_extract(line, '{_SPEAKER}', 1))) >= 4
                THEN trim(regexp_extract(line, '{_SPEAKER}', 1)) END AS label FROM y),
            t AS (SELECT *, count(label) OVER (PARTITION BY file ORDER BY pos) - 1 AS turno,
              CASE WHEN label IS NOT NULL THEN trim(regexp_extract(line, '{_SPEAKER}', 2)) ELSE line END AS said FROM z WHERE over = 0),
            g AS (SELECT file, turno, max(label) AS hablante, trim(string_agg(said, ' ' ORDER BY pos)) AS texto FROM t WHERE turno >= 0 GROUP BY ALL)
            SELECT file, turno, {_type("hablante")} AS tipo, hablante, texto FROM g""",
        "document_header": f"""WITH {_FILES} SELECT file, {_head("URL:")} AS url, {_head("Fecha:")} AS fecha, {_head("Título:")} AS titulo,
            contains(value, '(CONTINÚA…)') AS incompleto, array_to_string(l[4:], chr(10)) AS body FROM ln""",
        "date_url_map": f"""WITH {_FILES}, h AS (SELECT file, {_head("URL:", 3)} AS url, {_head("Fecha:", 3)} AS fecha FROM ln)
            SELECT fecha, arg_max(url, file) AS url FROM h WHERE url <> '' AND fecha <> '' GROUP BY fecha""",
        "latest_document": f"WITH {_FILES} SELECT file, {_head('Fecha:')} AS fecha, {_head('Título:')} AS titulo FROM ln ORDER BY file DESC LIMIT 1",
        "paragraph_clean": f"WITH c AS (SELECT doc_id, {_CLEAN.format('text')} AS texto FROM documents) SELECT * FROM c WHERE length(texto) >= 500",
        "page_links": f"WITH {_FROM_LINKS} SELECT page_id, pos, href FROM lk",
        "url_dedup": f"WITH {_FROM_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS r FROM lk) SELECT href, page_id, pos FROM r WHERE r = 1",
        "page_title_text": f"""WITH e AS (SELECT page_id, {_inner("h1")} AS titulo, {_inner("article")} AS art, {_inner("main")} AS mn, {_inner("body")} AS bd,
              coalesce(nullif({_meta("name")}, ''), left({_meta("property")}, 10), '') AS fecha_meta FROM pages),
            t AS (SELECT *, coalesce(CASE WHEN length(art) > 300 THEN art END, CASE WHEN length(mn) > 300 THEN mn END, bd) AS x FROM e)
            SELECT page_id, titulo, fecha_meta, {_CLEAN.format("x")} AS texto FROM t""",
        "page_meta_date": """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN CAST(DATE '2025-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR) ELSE '' END AS fecha_meta FROM pages""",
        "page_url_list": f"""WITH {_ARCHIVE} SELECT archive, page, CASE WHEN page = 1 THEN 'https://example.org/archivo/articulos'
            ELSE 'https://example.org/archivo/articulos?filter_origin=archive&idiom=es&order=DESC&page=' || CAST(page AS VARCHAR) END AS url FROM pg""",
        "archive_scan": f"""WITH {_ARCHIVE}, k AS (SELECT ln.* FROM ln JOIN sp USING (archive) WHERE (parada IS NULL OR page <= parada) AND d >= DATE '2024-10-01'),
            r AS (SELECT *, row_number() OVER (PARTITION BY archive, url ORDER BY page, pos) AS r FROM k)
            SELECT archive, url, CAST(d AS VARCHAR) AS fecha, page, CAST(pos AS INTEGER) AS pos FROM r WHERE r = 1""",
        "archive_stops": f"""WITH {_ARCHIVE} SELECT archive, count(*) AS paginas, count(*) FILTER (NOT ok) AS sin_respuesta, any_value(parada) AS parada, max(motivo) FILTER (page = parada) AS motivo
            FROM rs JOIN sp USING (archive) WHERE parada IS NULL OR page <= parada GROUP BY archive""",
        "date_from_slug": f"""WITH {TURNS}, {_SLUGS}, s AS (SELECT page_id, pos, href AS url FROM sl), t AS (SELECT *, {_SLUG_TEXT} AS texto FROM s)
            SELECT page_id, pos, url, texto, CAST(TRY_CAST(texto AS DATE) AS VARCHAR) AS fecha FROM t""",
        "archive_articles": f"""WITH {TURNS}, {_SLUGS}, s AS (SELECT {_ABSOLUTE} AS url FROM sl WHERE contains(href, 'version-estenografica')),
            t AS (SELECT DISTINCT url, TRY_CAST({_SLUG_TEXT} AS DATE) AS d FROM s) SELECT url, CAST(d AS VARCHAR) AS fecha FROM t WHERE d >= DATE '2024-10-01'""",
        "archive_latest": f"""WITH {TURNS}, {_SLUGS}, s AS (SELECT page_id, pos, {_ABSOLUTE} AS url FROM sl WHERE contains(href, 'version-estenografica-conferencia-de-prensa')),
            t AS (SELECT page_id, pos, url, {_SLUG_TEXT} AS fecha FROM s) SELECT url, fecha FROM t WHERE fecha <> '' ORDER BY page_id, pos LIMIT 1""",
        "pending_fetch": f"""WITH {EVENTS}, l AS (SELECT DISTINCT fecha, 'u/' || fecha AS url, day(CAST(fecha AS DATE)) AS dd FROM ev)
            SELECT fecha, url FROM l WHERE NOT (dd % 2 = 0 AND dd % 4 <> 0)""",
        "document_upsert": f"""WITH {_FILES},
            st AS (SELECT file, {_head("Fecha:")} AS fecha, {_head("Título:")} AS titulo, contains(value, '(CONTINÚA…)') AS incompleto, array_to_string(l[4:], chr(10)) AS body, 0 AS nw FROM ln),
            fe AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS file, CAST(DATE '2024-10-02' + CAST(doc_id % 500 AS INTEGER) AS VARCHAR) AS fecha, lang AS titulo,
              doc_id % 3 = 0 AS incompleto, text AS body, 1 AS nw FROM documents WHERE length(text) >= 500),
            r AS (SELECT *, row_number() OVER (PARTITION BY fecha ORDER BY incompleto, CASE WHEN incompleto THEN nw ELSE -nw END, file DESC) AS r FROM (SELECT * FROM st UNION ALL SELECT * FROM fe))
            SELECT fecha, file, incompleto, titulo, body FROM r WHERE r = 1""",
        "period_labels": f"""WITH {TURNS}, d AS (SELECT DISTINCT fecha FROM turns)
            SELECT fecha, {_list([m[:3].capitalize() for m in vocab.MONTHS])}[CAST(substr(fecha, 6, 2) AS INTEGER)] || ' ' || substr(fecha, 1, 4) AS mes,
              CAST(CAST(substr(fecha, 9, 2) AS INTEGER) AS VARCHAR) || ' de ' || {_list(vocab.MONTHS)}[CAST(substr(fecha, 6, 2) AS INTEGER)] || ' de ' || substr(fecha, 1, 4) AS largo,
              substr(fecha, 1, 4) AS anio FROM d""",
        "given_topic_share_date": f"{_given_topics(frames)} SELECT fecha, topico, peso FROM dia",
        "given_topic_share_month": f"""{_given_topics(frames)}, mm AS (SELECT substr(fecha, 1, 7) AS mes, 't' || topico AS t, CAST(round(round(avg(peso), 4) * 100) AS INTEGER) AS pct FROM dia GROUP BY 1, 2)
            {_pivot("mm", "mes", "t", "pct", [f"t{i}" for i in range(len(frames))], "0")}""",
        "incremental_ingest": f"""WITH {_FILES}, dr AS (SELECT 0 AS k, file, value FROM f UNION ALL SELECT 1, 'b-' || file, replace(value, '(CONTINÚA…)', '') FROM f WHERE CAST(left(file, 12) AS BIGINT) % 2 = 0
              UNION ALL SELECT 2, 'c-' || file, value FROM f),
            l0 AS (SELECT k, file, value, string_split(regexp_replace(value, '\\n$', ''), chr(10)) AS l FROM dr),
            h AS (SELECT *, {_head("Fecha:")} AS fecha, {_head("Título:")} AS titulo, contains(value, '(CONTINÚA…)') AS cut, length(array_to_string(l[4:], chr(10))) >= 500 AS good FROM l0),
            o AS (SELECT *, row_number() OVER (PARTITION BY fecha ORDER BY k, file) AS i FROM h),
            w AS (SELECT *, min(CASE WHEN good AND NOT cut THEN i END) OVER (PARTITION BY fecha) AS whole, min(CASE WHEN good AND cut THEN i END) OVER (PARTITION BY fecha) AS part FROM o),
            s AS (SELECT *, CASE WHEN i > whole THEN 'presente' WHEN i = whole OR (i = part AND i < coalesce(whole, i + 1)) THEN 'ok' ELSE 'fallo' END AS status, i = coalesce(whole, part) AS held FROM w)
            SELECT fecha, file, status, CASE WHEN held THEN titulo END AS titulo, CASE WHEN held THEN cut END AS incompleto FROM s""",
        "actor_dates_selected": f"""WITH RECURSIVE {_RESOLVED}, tt AS (SELECT nombre, sum(n) AS n FROM rs GROUP BY 1), ct AS (SELECT tt.*, categoria FROM tt JOIN nm ON lbl = tt.nombre),
            sl AS (SELECT nombre FROM ct WHERE categoria IN ('gobernadores', 'secretarios') UNION SELECT nombre FROM (SELECT nombre FROM ct ORDER BY n DESC, nombre LIMIT 3))
            SELECT rs.nombre, fecha, count(*) AS turnos FROM oficial JOIN rs ON rs.variante = {_NORM.format("hablante")} WHERE rs.nombre IN (SELECT nombre FROM sl) GROUP BY 1, 2""",
        "corpus_newest_first": f"""WITH {TURNS} SELECT row_number() OVER (ORDER BY fecha DESC, conv_id, turno) - 1 AS orden, fecha, conv_id, turno FROM turns WHERE tipo = 'presidenta'""",
    }
