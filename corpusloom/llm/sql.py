"""SQL twins of the training-data queries: plain statements over whole tables.

``p7_leaks``, ``p8_mix``, ``p9_found`` and the like have none: their methods (edits, a schedule,
grammars with context) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

_DOCS = """
last AS (SELECT doc_id, unnest(arg_max(struct_pack(t := tokens), loaded_at).t) AS term_id FROM corpus_docs GROUP BY doc_id),
ids AS (SELECT term_id, lower(trim(term)) AS word FROM vocab WHERE term IS NOT NULL),
cnt AS (SELECT doc_id, word, count(*) AS n FROM last JOIN ids USING (term_id) GROUP BY doc_id, word)
"""

_VECTORS = """
raw AS (
  SELECT 'word' AS kind, CAST(term_id AS BIGINT) AS id, vec FROM word_vectors
  UNION SELECT 'topic', CAST(topic AS BIGINT), vec FROM topic_vectors
  UNION SELECT 'doc', CAST(doc_id AS BIGINT), vec FROM doc_vectors
),
ok AS (
  SELECT DISTINCT kind, id, CAST(vec AS DOUBLE[]) AS v FROM raw
  WHERE vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0
),
unit AS (SELECT kind, id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM ok)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH {_DOCS},
size AS (SELECT doc_id, sum(n) AS s FROM cnt GROUP BY doc_id HAVING sum(n) >= 10),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m
  FROM cnt a JOIN cnt b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY 1, 2
)
SELECT x AS doc_id_a, y AS doc_id_b FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
WHERE m * 10 >= 8 * (p.s + q.s - m)""",
        "p2_found": f"""
WITH {_DOCS},
freq AS (SELECT word, count(*) AS df FROM cnt GROUP BY word),
total AS (SELECT count(DISTINCT doc_id) AS d FROM cnt)
SELECT option_set, word AS term, 'rare' AS mark FROM freq, load_options WHERE df < min_doc_freq
UNION ALL
SELECT option_set, word, 'common' FROM freq, load_options, total WHERE df > ceil(d * max_doc_fraction)""",
        "p2_frequencies": f"""
WITH {_DOCS}
SELECT word AS term, CAST(sum(n) AS BIGINT) AS total_freq, count(*) AS doc_freq FROM cnt GROUP BY word""",
        "p3_found": """
WITH rows AS (
  SELECT 'topic_word' AS matrix, topic, CAST(term_id AS BIGINT) AS item_id, weight, written_at FROM topic_word
  UNION ALL SELECT 'doc_topic', topic, doc_id, weight, written_at FROM doc_topic
),
last AS (SELECT matrix, topic, item_id, arg_max(struct_pack(w := weight), written_at).w AS weight FROM rows GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY matrix, topic ORDER BY weight DESC, item_id) AS place FROM last WHERE weight IS NOT NULL AND NOT isnan(weight)
)
SELECT matrix, topic, item_id FROM ranked WHERE place <= 10""",
        "p5_found": f"""
WITH {_DOCS},
freq AS (SELECT word, count(*) AS n FROM cnt GROUP BY word),
total AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS d FROM cnt),
pairs AS (SELECT a.word AS x, b.word AS y, count(*) AS n FROM cnt a JOIN cnt b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT x AS term_a, y AS term_b FROM pairs JOIN freq p ON p.word = x JOIN freq q ON q.word = y, total
WHERE CASE WHEN pairs.n = d THEN true ELSE ln(pairs.n * d / (CAST(p.n AS DOUBLE) * q.n)) / -ln(pairs.n / d) >= 0.6 END""",
        "p6_found": f"""
WITH RECURSIVE {_VECTORS},
d AS (SELECT id, u FROM unit WHERE kind = 'doc'),
link AS (SELECT a.id AS x, b.id AS y FROM d a JOIN d b ON list_inner_product(a.u, b.u) >= 0.78),
reach(id, root) AS (SELECT id, id FROM d UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.id),
home AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT root AS cluster_key, id AS doc_id FROM home WHERE root IN (SELECT root FROM home GROUP BY root HAVING count(*) >= 5)""",
        "p7_found": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs WHERE len(w) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
        # no case hangs on the tokenizer: characters stand in for tokens
        "p8_found": r"""
WITH size AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, sum(length(text)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT lower(trim(m.source)) AS source, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets m LEFT JOIN size s ON s.source = lower(trim(m.source)))
SELECT source FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)""",
    }
