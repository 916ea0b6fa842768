"""DuckDB SQL for the operators that SQL can express, over whole tables: plain definitions, without the operators' methods."""

#: Lower-cased words of letters, digits and whatever is not ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, list_slice(w, i, i + 7) AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS MATERIALIZED (SELECT DISTINCT g, len(g) AS n FROM p),
d AS MATERIALIZED (SELECT doc_id, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, g, n FROM d JOIN k USING (g)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h JOIN p USING (g)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""


OP10 = r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
h AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS MATERIALIZED (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM h) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda i: m[i] IS NULL)) END AS kept
 FROM w LEFT JOIN (SELECT doc_id, gone, map_from_entries(list_transform(gone, lambda j: {'k': j, 'v': true})) AS m FROM c) USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


OP1 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, label, e, len(e) AS d FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.node = vec_id"""


OP7 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS s FROM w WHERE len(w) > 0),
f AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS m, s, len(s) AS n FROM s GROUP BY s),
t AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM f),
u AS MATERIALIZED (SELECT rep, n, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS q FROM t) WHERE q > 1),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
r AS (SELECT a AS node, a AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
x AS (SELECT p.a AS node, sum(f.m) AS other FROM p JOIN f ON f.rep = p.b GROUP BY p.a)
SELECT w.doc_id, coalesce(class_id, rep, w.doc_id) AS class_id, CAST(coalesce(m - 1, 0) + coalesce(other, 0) AS BIGINT) AS n_links, w.doc_id = coalesce(class_id, rep, w.doc_id) AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN f ON f.s = s.s LEFT JOIN c ON c.node = rep LEFT JOIN x ON x.node = rep"""

ORACLES = {"op1_near_vectors": OP1, "op6_decontamination": OP6, "op7_ngram_jaccard": OP7, "op10_substring_dedup": OP10}
