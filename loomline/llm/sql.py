"""DuckDB SQL of the training-data queries that SQL can express."""

P2_FOUND = r"""
WITH w AS (
  SELECT DISTINCT sentence_id, list_sort(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS ws
  FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL AND sentence IS NOT NULL
), b AS (SELECT ws, row_number() OVER () AS bag, len(ws) AS n FROM (SELECT DISTINCT ws FROM w WHERE len(ws) >= 8)),
t AS (
  SELECT bag, n, word, count(*) AS times FROM (SELECT bag, n, unnest(ws) AS word FROM b) GROUP BY ALL
), p AS (
  SELECT x.bag AS a, y.bag AS b FROM t x JOIN t y ON x.word = y.word AND x.bag < y.bag
  GROUP BY x.bag, y.bag, x.n, y.n HAVING sum(least(x.times, y.times)) >= 0.8 * greatest(x.n, y.n) - 1e-9
), m AS (SELECT DISTINCT sentence_id AS k, bag FROM w JOIN b USING (ws)),
q AS (
  SELECT x.k AS ka, y.k AS kb FROM m x JOIN m y ON x.bag = y.bag AND x.k < y.k
  UNION SELECT least(x.k, y.k), greatest(x.k, y.k) FROM p JOIN m x ON x.bag = p.a JOIN m y ON y.bag = p.b WHERE x.k <> y.k
) SELECT ka AS sentence_id_a, kb AS sentence_id_b FROM q
"""

P3_FOUND = "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1000"

_CLEAN_DOC = r"""
  CASE WHEN regexp_replace(coalesce(doc_id, ''), '^\s+|\s+$', '', 'g') <> '' THEN lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g'))
       WHEN regexp_extract(sentence_id, '(?s)^(.*)_s', 1) <> '' THEN lower(regexp_replace(regexp_extract(sentence_id, '(?s)^(.*)_s', 1), '^\s+|\s+$', '', 'g'))
       ELSE lower(sentence_id) END
"""

P4_FOUND = f"""
WITH RECURSIVE t AS (SELECT DISTINCT {_CLEAN_DOC} AS doc, sentence_id FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL),
e AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM t x JOIN t y USING (sentence_id) WHERE x.doc <> y.doc),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM r WHERE a < b
"""

P4_COMPONENTS = f"""
WITH RECURSIVE t AS (SELECT DISTINCT {_CLEAN_DOC} AS doc, sentence_id FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL),
e AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM t x JOIN t y USING (sentence_id) WHERE x.doc <> y.doc),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, least(a, min(b)) AS component FROM r GROUP BY a
"""

P4_BALANCED = "SELECT split_name, target_permille FROM split_targets"

P5_REPORT = rf"""
WITH g AS (SELECT lower(translate(trim(topic), '- ', '__')) AS topic, target_permille, min_rows, max_per_doc FROM sample_targets),
o AS (
  SELECT DISTINCT lower(translate(regexp_replace(topic, '^\s+|\s+$', '', 'g'), '- ', '__')) AS topic, {_CLEAN_DOC} AS doc, sentence_id
  FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL
), k AS (SELECT o.* FROM o WHERE topic IN (SELECT topic FROM g)),
n AS (SELECT count(DISTINCT sentence_id) // 5 AS n FROM k),
d AS (SELECT topic, doc, count(*) AS have FROM k GROUP BY ALL),
s AS (SELECT topic, sum(least(have, max_per_doc)) AS offered FROM d JOIN g USING (topic) GROUP BY topic),
f AS (
  SELECT g.topic, CAST(greatest(min_rows, ceil(n * target_permille / 1000.0)) AS BIGINT) AS needed, CAST(coalesce(offered, 0) AS BIGINT) AS offered
  FROM g CROSS JOIN n LEFT JOIN s USING (topic)
) SELECT topic, needed, offered, greatest(0, needed - offered) AS missing FROM f
"""

P5_FOUND = f"SELECT topic FROM ({P5_REPORT}) WHERE missing > 0"

P8_FOUND = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages WHERE text IS NOT NULL),
ds AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM dw WHERE len(w) >= 10),
it AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM iw WHERE len(w) >= 10),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM ds),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g FROM it)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P8_ITEMS = f"""
SELECT p.item_id, p.qid, count(DISTINCT f.doc_id) AS documents FROM (SELECT DISTINCT item_id, qid FROM eval_passages) p
LEFT JOIN ({P8_FOUND}) f ON f.item_id = p.item_id GROUP BY p.item_id, p.qid
"""

P2_CLASSES = r"""
WITH w AS (
  SELECT DISTINCT sentence_id, list_sort(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS ws
  FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL AND sentence IS NOT NULL
), b AS (SELECT DISTINCT ws, md5(array_to_string(ws, ' ')) AS bag, len(ws) AS n FROM w WHERE len(ws) >= 8),
t AS (SELECT bag, n, word, count(*) AS times FROM (SELECT bag, n, unnest(ws) AS word FROM b) GROUP BY ALL),
p AS (
  SELECT x.bag AS bag, y.bag AS other FROM t x JOIN t y ON x.word = y.word AND x.bag <> y.bag
  GROUP BY x.bag, y.bag, x.n, y.n HAVING sum(least(x.times, y.times)) >= 0.8 * greatest(x.n, y.n) - 1e-9
), l AS (SELECT bag, count(*) AS links FROM p GROUP BY bag)
SELECT DISTINCT sentence_id, bag AS class_id, coalesce(links, 0) AS links FROM w JOIN b USING (ws) LEFT JOIN l USING (bag)
"""
