"""DuckDB oracle SQL for sources (A2, A8) and search-result jobs (F)."""

from __future__ import annotations

from checks import sqlparts as S
from webspin import dims
from webspin.plans.catalog_search import BLOCKED, PREFERRED, QUERY_TYPE_CYCLE
from webspin.sources.derived import LANG_SEGMENT_RE

SR = f"""sr AS (
  SELECT page_id, regexp_extract(url, {S.q(LANG_SEGMENT_RE)}, 1) AS query, url,
         {S.url_host(S.canonical_url('url'))} AS host,
         row_number() OVER (PARTITION BY regexp_extract(url, {S.q(LANG_SEGMENT_RE)}, 1) ORDER BY page_id) AS rank
  FROM pages)"""


def _any(col: str, names) -> str:
    return "(" + " OR ".join(f"contains({col}, {S.q(n)})" for n in names) + ")"


TEST_BLOCKED = dims.BLOCKED_DOMAINS + dims.TEST_BLOCKED_DOMAINS
TEST_PREFERRED = dims.PREFERRED_DOMAINS + dims.TEST_PREFERRED_DOMAINS

F1 = f"WITH {SR} SELECT page_id, host FROM sr WHERE NOT {_any('host', TEST_BLOCKED)}"
F2 = f"WITH {SR} SELECT page_id, host FROM sr WHERE {_any('host', TEST_PREFERRED)}"
F3 = f"""WITH {SR} SELECT page_id, host,
  CAST(CASE WHEN {_any('host', BLOCKED)} THEN 0 WHEN {_any('host', PREFERRED)} THEN 10 ELSE 5 END AS INTEGER)
  AS priority FROM sr"""
F4 = f"""WITH {SR} SELECT page_id, host FROM sr
  WHERE NOT {_any('host', TEST_BLOCKED)} AND {_any('host', ['example.org', 'example.net'])}
    AND NOT {_any('host', ['blog.'])}"""
F6 = f"WITH {SR} SELECT query, rank, page_id FROM sr WHERE rank <= 10"

_QT = f"list_extract({S.arr(QUERY_TYPE_CYCLE)}, CAST(page_id % {len(QUERY_TYPE_CYCLE)} AS INTEGER) + 1)"

F10 = f"""
WITH t AS (SELECT page_id, {_QT} AS query_type, lower(url) AS u FROM pages)
SELECT page_id, query_type,
  CASE WHEN query_type = 'academic' AND contains(u, 'arxiv') THEN 'academic'
       WHEN query_type = 'technical' AND contains(u, 'docs') THEN 'technical'
       WHEN contains(u, 'docs.') OR contains(u, 'github') THEN 'documentation'
       WHEN contains(u, 'stackoverflow') OR contains(u, 'reddit') THEN 'forum_post'
       ELSE 'article' END AS content_type
FROM t
"""

_ENGINE = "CASE event_type " + " ".join(f"WHEN {S.q(e)} THEN {S.q(g)}" for e, g in dims.EVENT_ENGINE) \
    + " ELSE 'duckduckgo' END"
SL = f"""sl AS (SELECT event_id, ts, {_ENGINE} AS engine, event_type <> 'error' AS success,
                       value AS search_time FROM events)"""
ENG = "eng AS (" + " UNION ALL ".join(
    f"SELECT {S.q(e)} AS engine, {str(en).lower()} AS enabled, {str(k).lower()} AS requires_api_key"
    for e, _n, k, en, _r, _t in dims.ENGINES) + ")"

F14 = f"""
WITH {SL}, {ENG},
g AS (SELECT engine, count(*) AS searches, count(*) FILTER (WHERE NOT success) AS errors,
             arg_max(success, (ts, event_id)) AS healthy,
             sum(CAST(round(search_time * 1000000) AS BIGINT)) / count(search_time) / 1000000.0::DOUBLE
               AS avg_search_time
      FROM sl GROUP BY engine)
SELECT g.*, eng.enabled, eng.requires_api_key FROM g LEFT JOIN eng USING (engine)
"""

F15 = f"""
WITH {SL}, {ENG}
SELECT DISTINCT engine FROM sl WHERE engine IN (SELECT engine FROM eng WHERE enabled AND NOT requires_api_key)
"""

def _f16():
    import re

    from checks import oracle_limiter as L
    from checks.oracle_logs import ROBOTS
    from checks import oracle_payloads as P

    ttl = P._ttl(P.H_KEY, "(event_type <> 'error')", 3600 * 10**6, "events")
    ttl = re.sub(r"\bo\b", "h_o", ttl)
    ttl = re.sub(r"\brec\b", "h_rec", ttl)
    lim = L.I4[len("\nWITH RECURSIVE "):].rstrip()
    return f"""
WITH RECURSIVE {lim},
{ttl},
{SL},
base AS (SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (WHERE success) AS successful,
                count(*) FILTER (WHERE NOT success) AS engine_failures FROM sl GROUP BY 1),
hits AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (WHERE hit) AS cache_hits FROM h_rec GROUP BY 1),
blk AS (SELECT date_trunc('day', r.ts) AS day, count(*) FILTER (WHERE NOT rec.allowed) AS rate_limit_blocks
        FROM rec JOIN rl r USING (event_id) WHERE rec.rn > 0 GROUP BY 1),
{ROBOTS},
pu AS (SELECT page_id, {S.two_label_domain(S.url_host('n'))} AS domain, {S.url_path('n')} AS path
       FROM (SELECT page_id, {S.canonical_url('url')} AS n FROM pages)),
pf AS (SELECT page_id, bool_or(kind = 'allow') AS a, bool_or(kind = 'disallow') AS d
       FROM pu JOIN rules ON pu.domain = rules.domain AND rules.agent IN ('webspinbot', '*') AND (
            prefix = '/' OR CASE WHEN ends_with(prefix, '*') THEN starts_with(path, left(prefix, length(prefix) - 1))
                                 ELSE starts_with(path, prefix) END) GROUP BY page_id),
rob AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (WHERE NOT (coalesce(pf.a, false) OR NOT coalesce(pf.d, false))) AS robots_blocks
        FROM sl JOIN pu ON sl.event_id = pu.page_id LEFT JOIN pf USING (page_id) GROUP BY 1)
SELECT base.day, total, successful, engine_failures, coalesce(cache_hits, 0) AS cache_hits,
       coalesce(rate_limit_blocks, 0) AS rate_limit_blocks, coalesce(robots_blocks, 0) AS robots_blocks
FROM base LEFT JOIN hits USING (day) LEFT JOIN blk USING (day) LEFT JOIN rob USING (day)
"""


F16 = _f16()

A2 = """
SELECT page_id, CAST(status AS INTEGER) AS status_code, (status >= 200 AND status < 400) AS success,
       CASE WHEN status >= 200 AND status < 400 THEN NULL ELSE 'HTTP ' || status END AS error,
       length(html) AS content_len
FROM (SELECT page_id, html, CASE page_id % 10 WHEN 7 THEN 404 WHEN 8 THEN 500 WHEN 9 THEN 301 ELSE 200 END AS status
      FROM pages)
"""

ELEMENTS = """
SELECT * FROM (
    SELECT page_id, 'nav > ul a' AS selector, len(regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</nav>', 1), '<a ')) AS n_elements FROM pages
    UNION ALL SELECT page_id, 'head title, h1', len(regexp_extract_all(html, '<title>|<h1>')) FROM pages) WHERE n_elements > 0
"""

A8 = """
WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text,
             CASE WHEN turn % 3 = 0 THEN to_json({'query': text, 'max_results': CAST(turn + 1 AS INTEGER)})::VARCHAR
                  WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN '{bad json'
                  WHEN turn % 3 = 1 THEN to_json({'query': text, 'max_results': CAST(turn + 1 AS INTEGER)})::VARCHAR || ' trailing'
                  ELSE text END AS raw FROM c),
j AS (SELECT *, CASE WHEN starts_with(trim(raw), '{') THEN try(json(raw)) END AS js FROM r)
SELECT conv_id, turn,
       coalesce(js->>'query', raw) AS query,
       coalesce(TRY_CAST(js->>'max_results' AS INTEGER), 10) AS max_results,
       coalesce(js->>'query_type', 'general') AS query_type,
       coalesce(TRY_CAST(js->>'extract_content' AS BOOLEAN), true) AS extract_content
FROM j
"""

ORACLE = {
    "A1_crawl_dump": A2,
    "A1_page_elements": ELEMENTS,
    "A2_fetch_outcomes": A2,
    "A8_parse_requests": A8,
    "F1_drop_blocked": F1,
    "F2_keep_preferred": F2,
    "F3_domain_priority": F3,
    "F4_filter_domains": F4,
    "F6_top_results": F6,
    "F10_infer_content_type": F10,
    "F14_engine_health": F14,
    "F15_available_engines": F15,
    "F16_tool_stats": F16,
}
