"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str) -> str:
    return f"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{pattern}'), [])"


MERKLE = """
WITH p AS (SELECT page_id, sha256(url || chr(10) || html) AS a, sha256(url || chr(10) || html || ' ') AS b, CAST(strlen(url || chr(10) || html) + 64 AS BIGINT) AS size, page_id // 4096 AS file FROM pages),
q AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM p)
SELECT page_id, CAST(1 AS BIGINT) AS copy, CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS status, a AS primary_sha256, CASE WHEN page_id % 193 <> 7 THEN b END AS replica_sha256, file, pos AS "offset", size
FROM q WHERE page_id % 193 = 7 OR page_id % 97 = 5
UNION ALL SELECT -1 - page_id, 1, 'extra', NULL, a, CAST(floor((-1 - page_id) / 4096.0) AS BIGINT), NULL, NULL FROM q WHERE page_id % 389 = 11
"""

NGRAMS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_SPACED)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM w WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_words(_ALNUM)} AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM k),
d AS (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT doc_id, p, k, item_id FROM dw JOIN win USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS p, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i:i + 2])) AS w FROM d WHERE len(l) >= 3),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(removed, 0) AS n_removed, CASE WHEN removed IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y FROM f JOIN (VALUES (1), (2)) c(k) ON k < size),
scored AS (SELECT c.*, u.f AS l, v.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(u.f AS HUGEINT) * v.f) AS BIGINT) AS score FROM cut c JOIN f u ON u.lang = c.lang AND u.phrase = x JOIN f v ON v.lang = c.lang AND v.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
