"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

from . import licenses

OP1 = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM x JOIN f USING (h), range(0, 13) r(k) WHERE least < doc_id),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
s AS (SELECT t.doc_id, count(g.j) AS n_removed, coalesce(string_agg(CASE WHEN g.j IS NULL THEN w[t.j] END, ' ' ORDER BY t.j), '') AS kept
  FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.j = t.j GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

OP8 = r"""
WITH known AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN q >= 1 THEN 2.0 WHEN q < 1 THEN 0.5 ELSE 1.0 END AS k
  FROM documents d LEFT JOIN known USING (doc_id)),
s AS (
  SELECT source, sum(size) AS source_size, 3.0 * sum(size) AS cap,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CAST(least(cap, max(CASE WHEN level * w <= cap THEN level END) OVER () * w) AS DOUBLE) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(target / source_size + 1e-9), 3) AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(copies AS INTEGER) AS copies, CAST(copies * size AS BIGINT) AS taken FROM (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN epochs < 3 AND before + size / 2 <= target - epochs * source_size
    THEN 1 ELSE 0 END END AS copies FROM p)
"""


def op11() -> str:
    """Every phrase at every word, every template against every block."""
    step = licenses.stride(licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {licenses.split(text)})" for label, text in licenses.PHRASES)
    sets = [(label, sorted(set(licenses.split(text)))) for label, text in licenses.TEMPLATES]
    templates = ", ".join(f"('{label}', {words}, {licenses.needed(len(words), licenses.SHARE)})" for label, words in sets)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents),
phrases(label, p) AS (VALUES {phrases}),
templates(label, t, least) AS (VALUES {templates}),
x AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases
  WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
b AS (SELECT r, list_distinct(w[i * {step} + 1:(i + 2) * {step}]) AS b
  FROM (SELECT r, w, unnest(range(0, (len(w) + {step} - 1) // {step})) AS i FROM d)),
y AS (SELECT r, label, len(list_intersect(b, t)) AS n, len(t) AS size FROM b, templates WHERE len(list_intersect(b, t)) >= least),
p AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM x GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM x UNION SELECT r, label FROM y) GROUP BY r),
s AS (SELECT r, max(n / size) AS score FROM y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""


def all_oracles() -> dict[str, str]:
    return {"op1_topk": OP1, "op4_ngram_join": OP4, "op6_substring": OP6, "op8_mixing": OP8, "op11_licenses": op11()}
