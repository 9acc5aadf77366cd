"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

CHAT = r"""
WITH t AS (
  SELECT conv_id, coalesce(CAST(floor(turn / 1000.0) AS BIGINT), -1) AS part, turn,
         coalesce(role, 'unknown') AS name, coalesce(text, '') AS said
  FROM conversations
), who AS (SELECT DISTINCT conv_id, name AS speaker FROM t
), p AS (
  SELECT t.conv_id, speaker, part, turn, name, said, name = speaker AS own,
         '<|im_start|>' || CASE WHEN name = speaker THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS header
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id
), q AS (
  SELECT *, coalesce(sum(length(header) + length(said) + 11) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, name, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM p
), g AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns, count_if(own) AS n_own,
         sum(length(header) + length(said) + 11) AS length,
         string_agg(header || said || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, name, said, place) AS rendered,
         list(CAST(place + length(header) AS BIGINT) ORDER BY place) FILTER (WHERE own) AS mask_starts,
         list(CAST(place + length(header) + length(said) AS BIGINT) ORDER BY place) FILTER (WHERE own) AS mask_ends
  FROM q GROUP BY conv_id, speaker, part
)
SELECT conv_id, speaker, part, n_turns, CAST(n_own AS BIGINT) AS n_own,
       CAST(coalesce(sum(length) OVER (PARTITION BY conv_id, speaker ORDER BY part
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       rendered, coalesce(mask_starts, []) AS mask_starts, coalesce(mask_ends, []) AS mask_ends
FROM g
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9) AS BIGINT) AS place
  FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS n FROM w
), l AS (
  SELECT a.source, a.source_size, a.weight,
         (SELECT max(level) FROM (
            SELECT b.source_size, b.weight,
                   ((SELECT sum(source_size) FROM f) - coalesce((SELECT sum(3 * c.source_size) FROM f c WHERE c.n < b.n), 0))
                   / ((SELECT sum(weight) FROM f) - coalesce((SELECT sum(c.weight) FROM f c WHERE c.n < b.n), 0)) AS level
            FROM f b) WHERE level <= 3 * source_size / weight) AS level
  FROM f a
), t AS (
  SELECT source, source_size, CAST(least(coalesce(level * weight, 3 * source_size), 3 * source_size) AS DOUBLE) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END AS passes FROM t
), r AS (SELECT *, greatest(target - passes * source_size, 0) AS rest FROM p
), h AS (
  SELECT source, place, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto, sum(size) AS words
  FROM d GROUP BY source, place
), k AS (
  SELECT h.source, h.place,
         upto <= rest OR (upto - words <= rest AND upto - rest < rest - (upto - words)) AS fits
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source
), c AS (SELECT source, min(place) FILTER (WHERE NOT fits) AS low FROM k GROUP BY source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (passes + CASE WHEN (low IS NULL OR place < low) AND passes < 3 AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

#: A to Z lower-cased; other capitals stay.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(@text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(@text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark
), s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_all FROM d
), q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ws) AS term FROM i) GROUP BY ALL
), p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term
), m AS (SELECT r, doc_id, 25 + (75 * CAST(len(ws) AS BIGINT) * n_docs) // n_all AS m FROM d, s
), c AS (
  SELECT q.i, q.item_id, m.r, m.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL
), k AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""".replace("@text", LOWER.format("text"))

LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(@text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(@text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), s AS (SELECT item, ws, least(len(ws), 10) AS size FROM i WHERE len(ws) > 0
), w AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(ws, p, p + size - 1), ' ') AS words
  FROM (SELECT item, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM s)
), g AS (
  SELECT r, size, p, array_to_string(list_slice(ws, p, p + size - 1), ' ') AS words
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size)
), h AS (SELECT r, p, size, item FROM g JOIN w USING (size, words)
), n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS place FROM h) GROUP BY r
), t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""".replace("@text", LOWER.format("text"))

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(@text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), t AS (SELECT r, lang, source, unnest(ws) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), x AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), c AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n
  FROM g JOIN k USING (lang) LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), s AS (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY lang, source
), p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (group_n + v) AS p, 1 + (1000000000::HUGEINT * (c.total + 1)) // (lang_n + v) AS q
  FROM c JOIN s USING (lang, source) JOIN v USING (lang)
), o AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), e AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source) LEFT JOIN o USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM f WHERE part = 'pair' OR rank <= 200
""".replace("@text", LOWER.format("coalesce(text, '')"))


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT, "op7_exact_dedup": EXACT, "op8_source_mix": MIX, "op11_ranked_search": SEARCH, "op12_decontamination": LEAKS, "op13_source_divergence": DIVERGENCE}
