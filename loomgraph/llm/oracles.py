"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from loomgraph.llm.queries import URL_LIST

_CHANGES = ", ".join(f"('{n}', '{k}', '{a}', TIMESTAMP '{d}')" for n, k, a, d in URL_LIST)

OP6_URL_FILTER = f"""
WITH changes(name, kind, action, day) AS (VALUES {_CHANGES}),
states AS (SELECT name, kind, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS off FROM changes GROUP BY ALL),
spans AS (SELECT name, kind, off, day AS valid_from, lead(day) OVER (PARTITION BY name, kind ORDER BY day) AS valid_to FROM states),
lists AS (SELECT * FROM spans WHERE off = 0),
base AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST((page_id * 37) % 366 AS INTEGER)) AS fetched_at,
    nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\\.?(:[0-9]*)?$', ''), '') AS host
  FROM pages),
asked AS (SELECT DISTINCT host, fetched_at FROM base WHERE host IS NOT NULL),
active AS (
  SELECT a.host, a.fetched_at, l.name, l.kind, l.valid_from
  FROM asked a JOIN lists l ON (a.host = l.name OR a.host LIKE '%.' || l.name)
   AND a.fetched_at >= l.valid_from AND (l.valid_to IS NULL OR a.fetched_at < l.valid_to)),
best AS (SELECT *, row_number() OVER (PARTITION BY host, fetched_at ORDER BY length(name) DESC, (kind = 'allow') DESC) AS n FROM active)
SELECT b.page_id, b.url, b.fetched_at, b.host, m.name AS matched_name, m.kind AS matched_kind, m.valid_from,
  coalesce(m.kind <> 'deny', true) AS kept
FROM base b LEFT JOIN (SELECT * FROM best WHERE n = 1) m USING (host, fetched_at)
"""

ORACLES = {"op6_url_filter": OP6_URL_FILTER}
