"""Registered query of the url filter, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .url_filter import LINK_TAG, LINK_TARGET, META_TAG, META_TARGET, Rule, filter_urls

RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ranked() -> str:
    rows = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return f"(VALUES {rows}) AS r(verdict, rhost, rpath)"


def _rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


#: A path with its dot segments resolved: the segments that are left after as many ascents as follow each of them.
_RESOLVE = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(substr(full_path, 2), '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1 : len(a) - 1] ELSE a || x END)"""

OP2_SQL = f"""
WITH RECURSIVE p0 AS (SELECT page_id, html, {_rest("coalesce(url, '')")} AS rest FROM pages),
p AS (
  SELECT page_id, html, {_host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         nullif({_host("rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '') AS node
  FROM p0
),
tags AS (
  SELECT host, path, node, regexp_extract(tag, {_quote(LINK_TARGET)}, 1) AS target
  FROM (SELECT *, unnest(regexp_extract_all(html, {_quote(LINK_TAG)})) AS tag FROM p)
  UNION ALL
  SELECT host, path, node, regexp_extract(tag, {_quote(META_TARGET)}, 1)
  FROM (SELECT *, unnest(regexp_extract_all(html, {_quote(META_TAG)})) AS tag FROM p)
),
known AS (
  SELECT *, regexp_extract(target, '^([^?#]*)', 1) AS bare, regexp_extract(target, '^[^?#]*(\\?[^#]*)', 1) AS query,
         starts_with(target, '//') OR strpos(target, '://') > 0 AS whole
  FROM tags
  WHERE host <> '' AND target <> '' AND NOT starts_with(target, '#')
    AND (NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://'))
),
far AS (SELECT node, {_rest("CASE WHEN starts_with(target, '//') THEN 'x:' || target ELSE target END")} AS rest FROM known WHERE whole),
near0 AS (
  SELECT node, host, bare, path, query,
         CASE WHEN starts_with(bare, '/') THEN bare WHEN strpos(path, '/') = 0 THEN '/' || bare
              ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) || bare END AS full_path
  FROM known WHERE NOT whole
),
near1 AS (SELECT *, {_RESOLVE} AS kept, string_split(full_path, '/')[-1] IN ('.', '..') AS dots FROM near0),
ends AS (
  SELECT node, {_host("rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS dst FROM far
  UNION ALL
  SELECT node, host || CASE WHEN bare = '' THEN path ELSE '/' || array_to_string(kept, '/') || CASE WHEN dots AND len(kept) > 0 THEN '/' ELSE '' END END || query
  FROM near1
),
e AS (
  SELECT node AS a, dst AS b FROM ends WHERE dst <> ''
  UNION SELECT dst, node FROM ends WHERE dst <> ''
),
reach AS (
  SELECT DISTINCT a AS node, a AS other FROM e
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a
),
parts AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
named AS (SELECT node, component, regexp_extract(node, '^([^/?]*)', 1) AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path FROM parts),
ranked AS (
  SELECT n.host, n.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) AS own
  FROM (SELECT DISTINCT host, path FROM p UNION SELECT host, path FROM named) n
  JOIN {_ranked()} ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)
  GROUP BY ALL
),
judged AS (
  SELECT component, coalesce(bool_or(own = 'block'), false) AS blocked, coalesce(bool_or(own = 'allow'), false) AS allowed
  FROM named LEFT JOIN ranked ON named.host = ranked.host AND named.path = ranked.path GROUP BY component
)
SELECT p.page_id, p.host, p.path, ranked.rule,
       coalesce(ranked.own, CASE WHEN judged.blocked AND NOT judged.allowed THEN 'block' ELSE 'allow' END) AS verdict,
       parts.component
FROM p LEFT JOIN ranked ON p.host = ranked.host AND p.path = ranked.path
LEFT JOIN parts ON parts.node = p.node LEFT JOIN judged USING (component)
"""

QUERIES = {"op2_url_filter": op2_url_filter}
SQL = {"op2_url_filter": OP2_SQL}
