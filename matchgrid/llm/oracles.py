"""Oracle SQL (DuckDB) of the near-duplicate and quality queries: all pairs, plainly, for small tables."""

from __future__ import annotations

from matchgrid.llm import quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "'[^\\x20\\x09-\\x0D]+'"

_REACH = """
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
nodes AS (SELECT w.id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT id, count(*) AS n FROM s GROUP BY id) USING (id)),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM c JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),{_REACH}
SELECT id AS doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN comp USING (id)
"""

OP5_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
ok AS (
  SELECT * FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(v, v) > 0),
links AS (
  SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.id <> q.id AND len(p.v) = len(q.v)
  WHERE list_dot_product(p.v, q.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(q.v, q.v)) >= 0.98),{_REACH}
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept
FROM nodes JOIN comp USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) USING (id)
"""

_SCORES = {
    "symbols": "n_symbols / word_chars", "capitals": "n_capitals / word_chars", "marks": "n_marks / word_chars", "lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words", "long_words": "word_chars / n_words",
}
_GRID = ", ".join(f"('{r}', {i + 1}, {c}::DOUBLE)" for r, (_, cs) in quality.RULES.items() for i, c in enumerate(cs))
_STEPS = max(len(cs) for _, cs in quality.RULES.values())
_R = quality.RISK

OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) x(k) GROUP BY doc_id),
f AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(l) AS n_lines FROM w LEFT JOIN p USING (doc_id)),
s AS (SELECT doc_id, stratum, unnest([{', '.join(f"'{k}'" for k in _SCORES)}]) AS rule, unnest([{', '.join(f'coalesce({v}, 0)' for v in _SCORES.values())}]) AS score FROM f),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
grid AS (SELECT * FROM (VALUES {_GRID}) v(rule, pos, cut)),
h AS (SELECT doc_id, stratum, strpos('0123456789abcdef', left(md5(CAST(doc_id AS VARCHAR)), 1)) <= {quality.TUNING} AS tunes, rule, pos, cut, score > cut AS hit FROM s JOIN good USING (doc_id) JOIN grid USING (rule)
  WHERE doc_id IN (SELECT doc_id FROM f WHERE NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words))),
last AS (
  SELECT stratum, rule, max(pos) AS last FROM (SELECT stratum, rule, pos, count(*) FILTER (tunes AND hit) AS k, count(*) FILTER (tunes) AS n FROM h GROUP BY ALL)
  WHERE k <= n * {quality.TUNED!r} GROUP BY 1, 2),
v AS (SELECT stratum, step, doc_id, bool_or(hit AND pos <= step AND pos <= last) AS rejected FROM h JOIN last USING (stratum, rule), range(1, {_STEPS + 1}) t(step) WHERE NOT tunes GROUP BY ALL),
b AS (
  SELECT stratum, step, CASE WHEN k >= n * {_R!r} THEN 1.0
    ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_R!r}) + (n - i) * ln(1 - {_R!r})))) END
    <= {quality.LEVEL} / (SELECT greatest(count(DISTINCT stratum), 1) FROM h) AS ok FROM (SELECT stratum, step, count(*) AS n, count(*) FILTER (rejected) AS k FROM v GROUP BY 1, 2)),
st AS (SELECT stratum, max(step) AS step FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS held FROM b) WHERE held GROUP BY 1),
c AS (SELECT stratum, rule, min(cut) AS cut FROM st JOIN last USING (stratum) JOIN grid USING (rule) WHERE pos <= step AND pos <= last GROUP BY 1, 2),
x AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position([{', '.join(f"'{k}'" for k in _SCORES)}], rule)) AS failed FROM s JOIN c USING (stratum, rule) WHERE score > cut GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM f LEFT JOIN x USING (doc_id)
"""
