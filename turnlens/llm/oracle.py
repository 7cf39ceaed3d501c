"""DuckDB SQL for the queries that SQL can express, each over all pairs, windows or blocks."""

from __future__ import annotations

import string

from turnlens.llm import licenses, rules

_LOW = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ALNUM = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BLANK = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_TEXT = "coalesce(text, '')"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_TEXT)} AS w FROM documents),
  b AS (SELECT item_id, {_ALNUM.format(_TEXT)} AS w FROM benchmark),
  b1 AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM b1),
  d1 AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
  dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d1),
  hit AS (SELECT doc_id, item_id, k, i FROM dw JOIN bw USING (k, g)),
  n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
  it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK.format(_LOW.format(_TEXT))} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS p, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(phrase.split()) - 1}] = {_list(phrase.split())}"
    for phrase, label in licenses.PHRASES.items()
)
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(licenses.words_of(text))))})" for label, text in licenses.TEMPLATES.values())
LICENSES = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_TEXT)} AS w FROM documents),
  pl AS ({_PLACES}),
  bl AS (SELECT doc_id, list_distinct({_ALNUM.format("b")}) AS h FROM (SELECT doc_id, unnest(string_split({_TEXT}, chr(10))) AS b FROM documents)),
  m AS (SELECT doc_id, label, CAST(len(list_intersect(h, t)) AS DOUBLE) / len(t) AS c FROM bl, (VALUES {_TEMPLATES}) v(label, t)
    WHERE 100 * len(list_intersect(h, t)) >= {licenses.THRESHOLD} * len(t)),
  p AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY 1),
  a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pl UNION ALL SELECT doc_id, label FROM m) GROUP BY 1),
  s AS (SELECT doc_id, max(c) AS score FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_BLANK.format(_TEXT)} AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
  x AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
  p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM x),
  u AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM d),
  k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM u ANTI JOIN p USING (doc_id, i) GROUP BY 1),
  n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

_BITS = " + ".join(f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rules.RULES))
_COUNT = "length(t) - length(regexp_replace(t, '[{0}]', '', 'g'))"
RULES = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t, {_BLANK.format(_TEXT)} AS w, {_ALNUM.format(_TEXT)} AS a,
    list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
  x AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
  p AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM x) GROUP BY 1),
  m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      {_COUNT.format("#*$%&|<>")} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(t) AS n_chars_all, len(l) AS n_lines, {_COUNT.format("A-Z")} AS n_upper, {_COUNT.format("a-z")} AS n_lower, {_COUNT.format("0-9")} AS n_digits,
      {_COUNT.format("!")} AS n_bangs, len(a) AS n_alnum_words, len(list_distinct(a)) AS n_distinct_words,
      coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS max_word_chars FROM d LEFT JOIN p USING (doc_id)),
  b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, fail_bits & {rules.BASE.mask} <> 0 AS base_failed,
  fail_bits & {rules.V1.mask} = 0 AS kept, fail_bits FROM b"""

ORACLE_SQL = {
    "op1_decontaminate": DECONTAMINATE,
    "op3_jaccard_join": JACCARD,
    "op4_license_scan": LICENSES,
    "op6_quality_rules": RULES,
    "op9_substring_dedup": SUBSTRINGS,
}
