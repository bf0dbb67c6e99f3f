"""SQL (DuckDB) that the text queries can be held against: the same results by plain joins over all windows."""

from __future__ import annotations

from ripplemark.llm.licenses import TEMPLATES
from ripplemark.llm.quality import STOCK, STOCK_WORDS
from ripplemark.llm.secrets import ADDED, BASE, NOT_BODY

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS own FROM w),
k AS (SELECT doc_id, CASE WHEN len(own) > 0 THEN md5(array_to_string(own, chr(1))) END AS k, own FROM s),
n AS (SELECT k, min(doc_id) AS first, count(*) AS copies, any_value(own) AS own FROM k WHERE k IS NOT NULL GROUP BY k),
e AS (SELECT k, len(own) AS size, unnest(own) AS g FROM n),
p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k HAVING count(*) >= 8e-1 * (any_value(a.size) + any_value(b.size) - count(*))),
r AS (SELECT k AS a, k AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS k, min(n.first) AS class_id FROM r JOIN n ON n.k = r.b GROUP BY 1),
l AS (SELECT a AS k, count(*) AS n_links FROM p GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(copies - 1, 0) AS n_copies
FROM k LEFT JOIN c USING (k) LEFT JOIN l USING (k) LEFT JOIN n USING (k)"""

_TEMPLATES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g"

OP3 = f"""
WITH t(template_id, text) AS (VALUES {_TEMPLATES}), tw AS (SELECT template_id, {_TOKENS} AS w FROM t), tg AS (SELECT template_id, {_SHINGLES} FROM tw WHERE len(w) >= 5),
ts AS (SELECT template_id, count(*) AS size FROM tg GROUP BY 1), dw AS (SELECT doc_id, {_TOKENS} AS w FROM documents), dg AS (SELECT doc_id, {_SHINGLES} FROM dw WHERE len(w) >= 5),
f AS (SELECT doc_id, template_id, count(*) / CAST(any_value(size) AS DOUBLE) AS part FROM dg JOIN tg USING (g) JOIN ts USING (template_id) GROUP BY 1, 2 HAVING count(*) >= 8e-1 * any_value(size)),
g AS (SELECT doc_id, count(*) AS n, string_agg(template_id, ',' ORDER BY template_id) AS ids, round(min(part), 6) AS least FROM f GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(ids, '') AS licenses, coalesce(least, 0e0) AS min_containment FROM documents LEFT JOIN g USING (doc_id)"""

_STOCK = "|".join(STOCK)

OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS h, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
rr AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM r), range(8) AS o(k) WHERE n > 1),
rn AS (SELECT doc_id, count(*) AS n FROM rr GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM w),
m AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS size, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS signs, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
 list_filter(list_transform(string_split_regex(line, '[|<>•·»›]'), lambda p: len(list_filter(string_split_regex(p, '[\x20\x09-\x0D]+'), lambda x: x <> ''))), lambda x: x > 0) AS parts FROM l),
f AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN size > 0 AND again THEN 1 ELSE 0 END), 0) AS BIGINT) AS dups,
 sum(CASE WHEN size > 0 AND (again OR (len(parts) >= 3 AND list_sum(parts) <= 25e-1 * len(parts)) OR signs > 2e-1 * size OR regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$') OR (regexp_matches(lower(line), '{_STOCK}') AND len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) <= {STOCK_WORDS}) OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]')) THEN size ELSE 0 END) AS lost FROM m GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, dups AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars FROM w LEFT JOIN rn USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 5e-1 * word_chars AS kept FROM b"""

OP5 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
c AS (SELECT h FROM d GROUP BY h HAVING count(*) > 1), v AS (SELECT DISTINCT doc_id, i + k AS i FROM d JOIN c USING (h), range(35) AS o(k)),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT t.doc_id, count(v.i) AS n, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE v.i IS NULL) AS kept FROM t LEFT JOIN v ON v.doc_id = t.doc_id AND v.i = t.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS pat FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
x AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS pat, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
h AS (SELECT doc_id, i, p.n, item FROM x JOIN p ON x.n = p.n AND x.pat = p.pat),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(10) AS o(k) WHERE k < n GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


#: Whole key blocks, as far as a pattern without looking around can tell them: a body without dashes, then the end.
_WHOLE = {"private": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?"}


def _kind(rank: int, kind: str, pattern: str) -> str:
    p = _quoted(_WHOLE.get(kind, pattern))
    value = f"regexp_extract(m[i], {p}, 1)" if kind == "assign" else "m[i]"
    if kind == "private":
        value = f"coalesce(nullif(regexp_replace(m[i], {_quoted(NOT_BODY)}, '', 'g'), ''), m[i])"
    start = "coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    rows = f"SELECT doc_id, source, string_split_regex(coalesce(text, ''), {p}) AS b, regexp_extract_all(coalesce(text, ''), {p}, 0) AS m FROM documents"
    return f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, CAST({start} AS BIGINT) AS s, length(m[i]) AS size, {value} AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({rows}) WHERE len(m) > 0)"


OP8 = f"""
WITH a AS ({" UNION ALL ".join(_kind(r, k, p) for r, (k, p) in enumerate((BASE | ADDED).items()))}),
f AS (SELECT * FROM a WHERE kind <> 'assign' OR length(value) >= 12),
o AS (SELECT value, count(DISTINCT source) > 1 AS shared FROM f GROUP BY 1),
k AS (SELECT doc_id, rank, kind, s, concat(kind, ':', s, ':', s + size) AS x, shared FROM f JOIN o USING (value) WHERE rank < 3 OR NOT shared),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans, count(*) FILTER (WHERE NOT shared) AS n_live FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM documents LEFT JOIN g USING (doc_id)"""


def _round(vectors: str, centroids: str) -> str:
    return f"SELECT r, vec_id, v, d.c, d.far FROM (SELECT r, vec_id, v, list_min(list_transform(c.all, lambda x: {{'far': list_sum(list_transform(range(1, 65), lambda i: (v[i] - x.v[i]) * (v[i] - x.v[i]))), 'c': x.c}})) AS d FROM {vectors}, (SELECT list({{'c': c, 'v': v}} ORDER BY c) AS all FROM {centroids}) AS c)"


def _moved(assigned: str, centroids: str) -> str:
    sums = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM {assigned}) GROUP BY c, i"
    means = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({sums}) GROUP BY c"
    return f"SELECT o.c, coalesce(m.v, o.v) AS v FROM {centroids} AS o LEFT JOIN ({means}) AS m USING (c)"


OP12 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS c, v FROM kept ORDER BY sha256(concat('1:', vec_id)), v LIMIT 16),
a1 AS MATERIALIZED ({_round("kept", "c0")}), c1 AS MATERIALIZED ({_moved("a1", "c0")}),
a2 AS MATERIALIZED ({_round("kept", "c1")}), c2 AS MATERIALIZED ({_moved("a2", "c1")}),
a3 AS MATERIALIZED ({_round("kept", "c2")}), c3 AS MATERIALIZED ({_moved("a3", "c2")}),
a4 AS MATERIALIZED ({_round("kept", "c3")})
SELECT vec_id, CAST(a4.c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY a4.c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a4 JOIN c3 ON a4.c = c3.c"""

OP11 = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 93e-2),
w AS (SELECT r AS a, r AS b FROM f UNION SELECT w.a, p.b FROM w JOIN p ON w.b = p.a),
c AS (SELECT w.a AS r, min(e.vec_id) AS component FROM w JOIN e ON e.r = w.b GROUP BY 1), n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM e LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""

_ASKED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ASKED} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, w FROM (SELECT DISTINCT item_id, {_ASKED} AS w, text FROM benchmark)),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT k, item_id, unnest(w) AS term FROM i),
x AS (SELECT k, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * n * big_n) // big_l AS BIGINT))))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10"""
