"""SQL, as DuckDB runs it, for what the operators of this subpackage compute that SQL can express."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"


def components(nodes: str, edges: str) -> str:
    """nodes(id) and edges(a, b), both ways -> parts(id, component): the smallest id that each reaches."""
    return f"reach AS (SELECT id, id AS r FROM {nodes} UNION SELECT reach.id, e.b FROM reach JOIN {edges} e ON e.a = reach.r), parts AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)"


NGRAM_JOIN = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY 1),
both_ AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
{components("w", "links")}
SELECT w.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(component AS BIGINT) AS component_id FROM w JOIN parts USING (id) LEFT JOIN n ON n.id = w.id"""

EMBEDDING_JOIN = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
{components("v", "links")}
SELECT v.id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = v.id) AS BIGINT) AS n_links, CAST(component AS BIGINT) AS component_id, v.id = component AS kept FROM v JOIN parts USING (id)"""

MIX_TARGETS = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY 1),
weighed AS (SELECT *, CASE k % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
edges AS (SELECT DISTINCT 3.0 * n / w AS edge FROM weighed),
levels AS (SELECT edge, (SELECT sum(n) FROM s) - coalesce(sum(3.0 * n) FILTER (3.0 * n / w < edge), 0) AS rest, sum(w) FILTER (3.0 * n / w >= edge) AS open, coalesce(max(3.0 * n / w) FILTER (3.0 * n / w < edge), 0) AS before FROM weighed, edges GROUP BY edge),
level AS (SELECT min(rest / open) FILTER (rest / open <= edge AND rest / open >= before) AS level FROM levels)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(w * coalesce(level, 1e18), 3.0 * n), 4) AS target FROM sized JOIN weighed ON sized.source IS NOT DISTINCT FROM weighed.source, level"""

BASE_RULES = rf"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
lines AS (SELECT doc_id, line, count(*) - 1 AS more FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(more) AS n FROM lines GROUP BY 1),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, (len(w) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(w)) AS base_failed FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)"""

DIGITS = r"list_transform(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''), lambda d: CAST(d AS INTEGER))"
LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i] WHEN d[i] > 4 THEN 2 * d[i] - 9 ELSE 2 * d[i] END)) % 10 = 0"
PII_COUNTS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) AS x FROM t),
cards AS (SELECT doc_id, {DIGITS} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')) AS x FROM t) WHERE length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 12 AND 19),
phones AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')) AS x FROM t)
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST((SELECT count(*) FROM ips WHERE ips.doc_id = t.doc_id AND len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0) AS BIGINT) AS n_ip,
CAST((SELECT count(*) FROM cards WHERE cards.doc_id = t.doc_id AND {LUHN}) AS BIGINT) AS n_card,
CAST((SELECT count(*) FROM phones WHERE phones.doc_id = t.doc_id AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS BIGINT) AS n_phone FROM t"""
