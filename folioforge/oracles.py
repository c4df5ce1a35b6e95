"""Long SQL of registered queries, for DuckDB; placeholders are filled in by queries.py."""

#: Paragraph parts of src (k1, k2, text): parts (k1, k2, part, body), as `structure.split_long` makes them.
PARTS = r"""
split0 AS (SELECT k1, k2, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS ss, @words(text) AS ws FROM src WHERE len(@words(text)) > 500),
sentence AS (SELECT k1, k2, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM split0 WHERE len(ss) > 1),
counted AS (SELECT *, len(@words(s)) AS w FROM sentence),
packed AS (
  SELECT k1, k2, i, s, w, CASE WHEN w > 500 THEN 0 ELSE w END AS n, 1 AS grp FROM counted WHERE i = 1
  UNION ALL
  SELECT c.k1, c.k2, c.i, c.s, c.w, CASE WHEN c.w > 500 THEN 0 WHEN p.n > 0 AND p.n + c.w <= 200 THEN p.n + c.w ELSE c.w END,
    CASE WHEN c.w <= 500 AND p.n > 0 AND p.n + c.w <= 200 THEN p.grp ELSE p.grp + 1 END
  FROM packed p JOIN counted c ON c.k1 = p.k1 AND c.k2 = p.k2 AND c.i = p.i + 1),
groups AS (SELECT k1, k2, grp, max(w) AS longest, string_agg(s, ' ' ORDER BY i) AS body FROM packed GROUP BY 1, 2, 3),
pieces AS (
  SELECT k1, k2, grp, 0 AS sub, body FROM groups WHERE longest <= 500
  UNION ALL SELECT k1, k2, grp, sub, array_to_string(list_slice(ws, sub * 200 + 1, sub * 200 + 200), ' ') FROM (SELECT k1, k2, grp, @words(body) AS ws, unnest(range(0, CAST(ceil(len(@words(body)) / 200.0) AS BIGINT))) AS sub FROM groups WHERE longest > 500)
  UNION ALL SELECT k1, k2, 0, sub, array_to_string(list_slice(ws, sub * 200 + 1, sub * 200 + 200), ' ') FROM (SELECT k1, k2, ws, unnest(range(0, CAST(ceil(len(ws) / 200.0) AS BIGINT))) AS sub FROM split0 WHERE len(ss) <= 1)
  UNION ALL SELECT k1, k2, 0, 0, text FROM src WHERE len(@words(text)) <= 500),
parts AS (SELECT k1, k2, row_number() OVER (PARTITION BY k1, k2 ORDER BY grp, sub) - 1 AS part, body FROM pieces)
"""

#: The document tree over lines as blocks, with ids.
TREE = r"""
bl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS bp, pos // 50 + 1 AS page, t FROM (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM lines) WHERE t <> ''),
dep AS (SELECT *, @depth(t) AS depth0, len(@words(t)) AS n FROM bl),
hd AS (SELECT *, CASE WHEN round(CASE WHEN depth0 > 0 THEN 0.9 ELSE 0.0 END + CASE WHEN upper(t) = t AND lower(t) <> t AND n <= 12 THEN 0.7 ELSE 0.0 END + CASE WHEN n <= 12 AND NOT regexp_matches(t, '[.!?]$') THEN 0.2 ELSE 0.0 END + CASE WHEN n > 20 THEN -0.4 ELSE 0.0 END, 6) >= 0.5 THEN greatest(depth0, 1) END AS d FROM dep),
anyh AS (SELECT *, max(CASE WHEN d IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS headed FROM hd),
up AS (SELECT *, max(CASE WHEN d = 1 THEN bp END) OVER w AS p1, max(CASE WHEN d = 2 THEN bp END) OVER w AS p2, max(CASE WHEN d = 3 THEN bp END) OVER w AS p3 FROM anyh WHERE headed = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY bp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
par AS (SELECT *, CASE WHEN d = 1 THEN -1 WHEN d = 2 THEN coalesce(p1, -1) WHEN d = 3 THEN greatest(coalesce(p1, -1), coalesce(p2, -1)) ELSE greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) END AS pp FROM up),
path AS (SELECT r.doc_id, r.bp, a.d AS pd, list_filter([c.t, b.t, a.t], lambda x: x IS NOT NULL) AS hp FROM par r LEFT JOIN par a ON a.doc_id = r.doc_id AND a.bp = r.pp LEFT JOIN par b ON b.doc_id = r.doc_id AND b.bp = a.pp LEFT JOIN par c ON c.doc_id = r.doc_id AND c.bp = b.pp),
src AS (SELECT doc_id AS k1, bp AS k2, t AS text FROM anyh WHERE d IS NULL),
@parts,
node0 AS (
  SELECT doc_id, 'root' AS key, NULL AS parent_key, 'document' AS node_type, 0 AS depth, 0 AS position, CAST([] AS VARCHAR[]) AS hp FROM bl GROUP BY 1
  UNION ALL SELECT doc_id, 'b:' || bp, CASE WHEN pp >= 0 THEN 'b:' || pp ELSE 'root' END, CASE d WHEN 1 THEN 'chapter' WHEN 2 THEN 'section' ELSE 'subsection' END, d, NULL, hp FROM par JOIN path USING (doc_id, bp) WHERE d IS NOT NULL
  UNION ALL SELECT doc_id, 'b:' || bp || ':' || part, CASE WHEN pp >= 0 THEN 'b:' || pp ELSE 'root' END, 'paragraph', coalesce(pd, 0) + 1, NULL, hp FROM par JOIN path USING (doc_id, bp) JOIN parts ON k1 = doc_id AND k2 = bp WHERE d IS NULL
  UNION ALL SELECT doc_id, 'g:' || g, 'root', 'section', 1, g - 1, CAST([] AS VARCHAR[]) FROM (SELECT doc_id, unnest(generate_series(1, CAST(ceil(max(page) / 5.0) AS BIGINT))) AS g FROM anyh WHERE headed = 0 GROUP BY doc_id)
  UNION ALL SELECT doc_id, 'b:' || bp || ':' || part, 'g:' || CAST(ceil(page / 5.0) AS BIGINT), 'paragraph', 2, NULL, CAST([] AS VARCHAR[]) FROM anyh JOIN parts ON k1 = doc_id AND k2 = bp WHERE headed = 0),
placed AS (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT) AS spot, CAST(CASE WHEN split_part(key, ':', 3) = '' THEN '0' ELSE split_part(key, ':', 3) END AS BIGINT) AS sub FROM node0 WHERE key <> 'root'),
ordered AS (SELECT doc_id, key, parent_key, node_type, depth, coalesce(position, row_number() OVER (PARTITION BY doc_id, parent_key ORDER BY spot, sub) - 1) AS position, hp FROM placed UNION ALL SELECT doc_id, key, parent_key, node_type, depth, position, hp FROM node0 WHERE key = 'root'),
named AS (SELECT *, 'node_' || substr(sha256('["node",' || to_json(CAST(doc_id AS VARCHAR)) || ',' || depth || ',' || position || ',' || to_json(hp) || ',' || to_json(coalesce(parent_key, '')) || ']'), 1, 32) AS node_id FROM ordered)
"""

#: The sentence with most of a question's terms, over ev (query_id, rank, question, node_id, text).
OVERLAP = r"""
es AS (SELECT query_id, rank, node_id, question, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS spot FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM ev)),
et AS (SELECT *, list_filter(@tokens(question), lambda x: NOT list_contains(@stop, x)) AS terms, @tokens(sentence) AS own FROM es),
eo AS (SELECT *, len(list_intersect(terms, own)) AS overlap FROM et),
eb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, spot, node_id) AS no FROM eo WHERE overlap >= CASE WHEN len(terms) > 1 THEN 2 ELSE 1 END)
SELECT query_id, node_id, sentence AS answer, overlap FROM eb WHERE no = 1
"""

#: Greedy choice of twelve phrases for each document, over sc (document_id, phrase, score); 12 are reached within the first 4000.
TOP_CONCEPTS = r"""
cand AS (SELECT * FROM (SELECT document_id, phrase, score, string_split(phrase, ' ') AS t, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, phrase) AS r FROM sc) WHERE r <= 4000),
pick AS (
  SELECT document_id, [t] AS kept, 1 AS place, phrase, score, r FROM cand WHERE r = 1
  UNION ALL
  SELECT * FROM (
    SELECT p.document_id, list_append(p.kept, c.t) AS kept, p.place + 1 AS place, c.phrase, c.score, c.r
    FROM pick p JOIN cand c ON c.document_id = p.document_id AND c.r > p.r
    WHERE p.place < 12 AND len(list_filter(p.kept, lambda k: list_has_all(k, c.t) OR list_has_all(c.t, k))) = 0
    QUALIFY row_number() OVER (PARTITION BY p.document_id ORDER BY c.r) = 1))
SELECT document_id, phrase, CAST(score AS DOUBLE) AS score, place FROM pick
"""
