"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .text import LOWER, UPPER

_LINK_COMPONENTS = """
reach AS (SELECT id, id AS seen FROM nodes UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen)"""

NGRAM_JOIN = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM grams),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),{_LINK_COMPONENTS},
low AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(g) AS n_shingles, component_id FROM grams JOIN low ON id = doc_id"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
sound AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
both_ways AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),{_LINK_COMPONENTS},
low AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM low LEFT JOIN n ON a = id"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

MIX_SOURCES = """WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
filled AS (SELECT *, 3 * source_size AS most, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER after AS BIGINT) AS weights FROM totals
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT max(rest / weights) FILTER (most * weights > rest * weight) AS level FROM filled),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), level * weight) END AS target FROM filled, level),
placed AS (SELECT doc_id, sized.source, size, row_number() OVER (PARTITION BY sized.source ORDER BY size DESC, md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS rank FROM sized),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, rank, CAST(CAST('0x' || substr(md5(coalesce(placed.source, '') || ':7'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS start FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * (rank + 1) + start) - floor(rate * rank + start), 3) AS BIGINT) * size AS taken FROM rated"""

EXACT_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SEARCH = f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERMS}') AS w FROM documents),
sized AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERMS}')) AS term FROM benchmark),
flat AS (SELECT doc_id, n, unnest(w) AS term FROM sized),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM dfs, totals),
parts AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS part FROM tfs JOIN weighed USING (term), totals),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""

SQL = {"op1_ngram_join": NGRAM_JOIN, "op2_near_vectors": NEAR_VECTORS, "op3_line_dedup": LINE_DEDUP, "op4_mix_sources": MIX_SOURCES, "op8_exact_top_k": EXACT_TOP_K, "op13_ranked_search": RANKED_SEARCH}
