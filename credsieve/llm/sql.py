"""SQL for the queries that DuckDB can express."""

from credsieve.llm.licenses import GENERIC

DECONTAMINATION = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_gram AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)),
doc_gram AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM doc, (SELECT DISTINCT m FROM item_gram) WHERE len(w) >= m)),
hit AS (SELECT r, i, m, item_id FROM doc_gram JOIN item_gram USING (m, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def licenses(templates: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    generic = ", ".join(f"'{name}'" for name in GENERIC)
    return rf"""
WITH template(template, license, text) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(lower(l), 'licen[sc]|copyright|rights reserved|warrant|permission|redistribut|spdx')) AS h
  FROM documents),
file AS (
  SELECT r, doc_id, h, text,
         coalesce(source, 'none') || '/' || CAST(coalesce(doc_id, 0) // 1000 AS VARCHAR) || '/' || CAST(coalesce(doc_id, 0) // 10 AS VARCHAR) AS dir,
         len(h) > 0 AND 5 * len(flatten(list_transform(h, lambda l: regexp_extract_all(lower(l), '[a-z0-9]+(?:[.-][a-z0-9]+)*'))))
           >= len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS is_license
  FROM lines),
header AS (SELECT r, line, hs[line] AS header
           FROM (SELECT r, hs, unnest(range(1, len(hs) + 1)) AS line
                 FROM (SELECT r, CASE WHEN is_license THEN list_concat([text], h) ELSE h END AS hs FROM file))),
counts AS (SELECT r, line, term, count(*) AS tf
           FROM (SELECT r, line, unnest(regexp_extract_all(lower(header), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM header)
           GROUP BY ALL),
once AS (SELECT c.* FROM counts c JOIN file USING (r) WHERE NOT is_license OR line = 1),
postings AS (SELECT template, license, term, count(*) AS tf
             FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM template)
             GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT r, line FROM once)) + (SELECT count(*) FROM template) AS n),
idf AS (SELECT term, ln((1 + n) / (1 + in_headers + in_templates)) + 1 AS idf
        FROM (SELECT term, count(*) AS in_templates FROM postings GROUP BY term)
        JOIN (SELECT p.term, count(c.r) AS in_headers FROM (SELECT DISTINCT term FROM postings) p LEFT JOIN once c USING (term) GROUP BY p.term) USING (term), n),
tw AS (SELECT template, license, term, tf * idf AS w FROM postings JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
hw AS (SELECT r, line, term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM counts LEFT JOIN idf USING (term), n),
hn AS (SELECT r, line, sqrt(sum(w * w)) AS norm FROM hw GROUP BY ALL),
score AS (SELECT r, license, round(least(1.0, sum(hw.w * tw.w / tn.norm) / any_value(hn.norm)), 6) AS score
          FROM hw JOIN tw USING (term) JOIN tn USING (template) JOIN hn USING (r, line) GROUP BY r, line, template, license),
best AS (SELECT r, license, score FROM score WHERE score >= 0.5
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY license IN ({generic}), score DESC, license) = 1),
licensed AS (SELECT dir, license FROM (SELECT dir, license, count(*) AS c FROM best JOIN file USING (r) WHERE is_license GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, license) = 1),
nearest AS (SELECT dir, a, license
            FROM (SELECT d.dir, l.dir AS a, l.license FROM (SELECT DISTINCT dir FROM file) d JOIN licensed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/'))
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(a) DESC) = 1)
SELECT doc_id, CASE WHEN is_license THEN f.dir || '/LICENSE.' ELSE f.dir || '/doc.' END || coalesce(CAST(doc_id AS VARCHAR), 'none') AS path,
       coalesce(b.license, x.license, 'none') AS license, coalesce(b.score, 0.0) AS score,
       CASE WHEN b.license IS NOT NULL THEN 'header' WHEN x.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN b.license IS NULL THEN x.a END AS from_dir
FROM file f LEFT JOIN best b USING (r) LEFT JOIN nearest x ON x.dir = f.dir
"""
