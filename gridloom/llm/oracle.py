"""SQL for the queries of this subpackage that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(d, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.d, sides.b FROM reach JOIN sides ON sides.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.r AS component_id, s.doc_id = m.r AS kept FROM s JOIN (SELECT d, min(r) AS r FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
t AS MATERIALIZED (SELECT doc_id, n, line, doc_id * 1048576 + n AS place, list_sort(list_distinct({_words("line", _SPACED)})) AS s FROM l),
c AS MATERIALIZED (SELECT s, min(place) AS first FROM t WHERE len(s) > 0 GROUP BY s),
u AS MATERIALIZED (SELECT first, len(s) AS m, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS f FROM u GROUP BY w),
p AS MATERIALIZED (SELECT first, m, w FROM (SELECT u.*, row_number() OVER (PARTITION BY first ORDER BY f, u.w) AS r FROM u JOIN f ON f.w = u.w) WHERE r <= m - (80 * m + 99) // 100 + 1),
k AS MATERIALIZED (SELECT DISTINCT a.first AS x, b.first AS y FROM p a JOIN p b ON a.w = b.w AND a.first > b.first AND least(a.m, b.m) * 100 >= 80 * greatest(a.m, b.m)),
i AS (SELECT x, len(a.s) + len(b.s) AS total, len(list_intersect(a.s, b.s)) AS shared FROM k JOIN c a ON a.first = x JOIN c b ON b.first = y),
g AS (SELECT DISTINCT x FROM i WHERE 100 * shared >= 80 * (total - shared)),
d AS (SELECT t.*, len(t.s) = 0 OR (c.first = t.place AND g.x IS NULL) AS keep FROM t LEFT JOIN c ON c.s = t.s LEFT JOIN g ON g.x = c.first)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep) AS n_kept, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keep), '')) AS kept_sha256 FROM d GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

WINDOWS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words("text", _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
a AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM g))),
h AS MATERIALIZED (SELECT a.doc_id, a.i, a.k, g.item_id FROM a JOIN g ON g.k = a.k AND g.g = a.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
