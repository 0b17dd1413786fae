"""DuckDB SQL with the same rows as the queries that SQL can express, over whole tables and texts."""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again),
grouped AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 400 AS e FROM grouped GROUP BY doc_id, run),
edges AS (SELECT doc_id, run, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS kept_from FROM spans),
cut AS (SELECT doc_id, list((kept_from, s - 1) ORDER BY s) AS parts, max(e) AS tail, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM edges GROUP BY doc_id),
joined AS (SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN parts IS NULL THEN b ELSE list_reduce(list_transform(parts, lambda p: b[p[1]:p[2]]) || [b[tail:]], lambda x, y: x || y) END AS kept FROM d LEFT JOIN cut USING (doc_id)),
t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(v[i:i + 50], ' ')) AS h FROM (SELECT doc_id, v, unnest(range(1, len(v) - 49)) AS i FROM t WHERE len(v) >= 51)),
met AS (SELECT doc_id, i FROM v JOIN (SELECT h FROM v GROUP BY h HAVING count(*) > 1) USING (h)),
begun AS (SELECT doc_id, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 51 THEN 0 ELSE 1 END AS fresh FROM met),
passages AS (SELECT doc_id, sum(fresh)::BIGINT AS n FROM begun GROUP BY doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(kept) AS kept_sha256, coalesce(n, 0) AS n_passages, n IS NOT NULL AS has_passage FROM joined LEFT JOIN passages USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT k FROM items),
windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN sizes ON len(w) >= k)),
met AS (SELECT doc_id, k, i, item_id FROM windows JOIN items USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, w, least(4, len(w)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(a, b) AS (SELECT a, b FROM sym UNION SELECT walk.a, sym.b FROM walk JOIN sym ON walk.b = sym.a),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM walk GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def _vector_codes(rounds: int = 4) -> str:
    """Rounds as chained relations: a holds the least 256 * distance + index of every part, c the codebooks."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, min((list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT * 256 + j) AS m FROM p JOIN c{r} USING (part) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, j, list(floor(s / n)::DOUBLE ORDER BY i) AS c FROM (SELECT part, m % 256 AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, part), range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, j))""")
    chain = ",\n".join(steps)
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[16 * part + 1:16 * part + 16] AS v FROM k, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS j, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{chain},
e AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, j, i)) AS codebooks_sha256 FROM c{rounds}, range(1, 17) t(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h"""


VECTOR_CODES = _vector_codes()

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM k),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM k) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
found AS (SELECT item, item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN k USING (r), s GROUP BY item, item_id, r),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM found JOIN k USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
