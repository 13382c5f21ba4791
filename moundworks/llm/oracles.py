"""DuckDB SQL with the same rows, where SQL can say what an operator returns."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
 u AS (SELECT doc_id, i, words[i] AS word, array_to_string(words[i:i + 19], ' ') AS w, i + 19 <= len(words) AS whole FROM d, unnest(range(1, len(words) + 1)) AS r(i)),
 k AS (SELECT *, row_number() OVER (PARTITION BY w, whole ORDER BY doc_id, i) AS n FROM u),
 m AS (SELECT doc_id, i, word, max(CASE WHEN whole AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM k)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, words"""

OP9 = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS copy_id FROM documents GROUP BY 1),
 v AS (SELECT copy_id, {WORDS} AS words FROM t),
 s AS (SELECT DISTINCT copy_id, array_to_string(words[i:i + 4], ' ') AS g FROM v, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS r(i)),
 z AS (SELECT copy_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN z x ON a = x.copy_id JOIN z y ON b = y.copy_id WHERE common >= 0.8 * (x.n + y.n - common)),
 c AS (SELECT copy_id AS a, copy_id AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
 l AS (SELECT a, min(b) AS class_id FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, class_id, copy_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN l ON l.a = copy_id LEFT JOIN n ON n.a = copy_id"""
