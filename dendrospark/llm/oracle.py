"""SQL for the numbered queries that SQL can say, for DuckDB over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


REACHED = "reached AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other), component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY 1)"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {words("[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
 s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), ids AS (SELECT id FROM d),
 pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
 near AS (SELECT a, b FROM pairs JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
 links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), {REACHED}
 SELECT d.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (id) JOIN component USING (id)"""

_W = words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
 b AS (SELECT item_id, {_W} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g FROM (SELECT *, least(13, len(w)) AS n FROM b) WHERE n > 0),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
 hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
 places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

# Base 32 of a SHA-1 from its hexadecimal digits: four bits a digit, five a letter.
_BITS = "array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4) FOR c IN string_split(sha1(h), '')], '')"
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, i, 1) AS INT) + 8 * CAST(substr(bits, i + 1, 1) AS INT) + 4 * CAST(substr(bits, i + 2, 1) AS INT) + 2 * CAST(substr(bits, i + 3, 1) AS INT) + CAST(substr(bits, i + 4, 1) AS INT), 1) FOR i IN range(1, 160, 5)], '')"
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages WHERE page_id IS NOT NULL), q AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, {_BITS} AS bits FROM p)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), ids AS (SELECT id FROM v),
 links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.9), {REACHED}
 SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM v JOIN component USING (id)"""

# A mask of the failed filters; orders are all strings of the five letters, each once.
AUDIT = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS g, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY 1),
 m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
 c AS (SELECT part, mask, count(*) AS n, coalesce(sum(g), 0) AS good, coalesce(sum(x), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
 s AS (SELECT o, step, substr(o, step, 1) AS f, 1 << (ascii(substr(o, step, 1)) - 65) AS own, list_sum([1 << (ascii(y) - 65) FOR y IN string_split(substr(o, 1, step - 1), '') IF y <> '']) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 r AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (mask & (own | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & b = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own > 0 AND mask & b > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & own > 0 AND mask & b = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (mask & own > 0 AND mask & b = 0), 0) AS toxic_lost
  FROM c, (SELECT *, CAST(coalesce(before, 0) AS INT) AS b FROM s) GROUP BY 1, 2, 3, 4)
 SELECT part, o AS filter_order, step, f AS filter, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

SQL = {"op2_ngram_jaccard": JACCARD, "op6_decontamination": DECONTAMINATION, "op8_warc": WARC, "op9_embedding_dedup": EMBEDDINGS, "op12_filter_audit": AUDIT}
