"""DuckDB oracle SQL for payload parsing (A3-A6), formatting (A9), search
jobs over parsed results (F5, F7, F11-F13) and the TTL replays (H2-H4, G4,
as recursive CTEs). The derived inputs are re-derived here by the same rules
as ``webspin.sources``."""

from __future__ import annotations

from checks import sqlparts as S
from webspin import dims
from webspin.plans.catalog_search import QUERY_TYPE_CYCLE
from webspin.sources.derived import LANG_SEGMENT_RE, TITLE_RE

DOCS = """d AS (
  SELECT doc_id, source, lang, text, source || ':' || lang AS query,
         trim(split_part(text, chr(10), 1)) AS title,
         'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS link,
         text AS snip
  FROM documents)"""

_T = S.clean_snippet("title")
_SN = S.clean_snippet("snip")

PARSED = f"""{DOCS},
g AS (SELECT query, 'google_custom' AS engine, CAST(1 AS INTEGER) AS rank, {_T} AS title, link AS url,
             {_SN} AS snippet, CAST(doc_id AS VARCHAR) AS cache_id
      FROM d WHERE doc_id % 50 <> 0 AND lang = 'en' AND {_T} <> ''),
x AS (SELECT query, 'searx' AS engine, CAST(1 AS INTEGER) AS rank, {_T} AS title, link AS url, {_SN} AS snippet,
             'google,bing' AS engines, (doc_id % 7) / 7.0::DOUBLE AS score FROM d WHERE {_T} <> ''),
b AS (SELECT query, 'bing' AS engine, CAST(1 AS INTEGER) AS rank, {_T} AS title, link AS url, {_SN} AS snippet,
             link AS display_url FROM d WHERE {_T} <> ''),
res AS (SELECT query, engine, rank, title, url, snippet FROM g
        UNION ALL SELECT query, engine, rank, title, url, snippet FROM x
        UNION ALL SELECT query, engine, rank, title, url, snippet FROM b)"""

A3 = f"WITH {PARSED} SELECT query, rank, title, url, cache_id FROM g"
A4 = f"WITH {PARSED} SELECT query, rank, title, url, engines, score FROM x"
A5 = f"WITH {PARSED} SELECT query, rank, title, url, display_url FROM b"

A6 = f"""
WITH {DOCS},
i AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS abstract,
             title || ' - ' || source AS topic FROM d)
SELECT query, CAST(1 AS INTEGER) AS rank, coalesce(title, query) AS title, link AS url, left(abstract, 300) AS snippet
FROM i WHERE coalesce(abstract, '') <> ''
UNION ALL
SELECT query, CAST(CASE WHEN coalesce(abstract, '') <> '' THEN 2 ELSE 1 END AS INTEGER) AS rank,
       split_part(topic, ' - ', 1) AS title, link AS url, left(topic, 300) AS snippet
FROM i WHERE coalesce(topic, '') <> ''
"""

F12 = f"""
WITH {PARSED}
SELECT query, engine, rank, url FROM res
WHERE trim(title) <> '' AND NOT regexp_matches(trim(title), '^[0-9]+$')
  AND NOT starts_with(lower(trim(title)), 'click here')
"""

F13 = f"""
WITH {PARSED}, n AS (SELECT query, engine, rank, {S.canonical_url('url')} AS url FROM res)
SELECT query, engine, rank, url, {S.two_label_domain(S.url_host('url'))} AS domain FROM n
"""

F7 = f"""
WITH {PARSED},
ok AS (SELECT query, engine, bool_or(NOT (engine = 'google_custom' AND doc_id % 50 = 0)) AS success
       FROM (SELECT query, doc_id, unnest(['google_custom', 'searx', 'bing', 'instant_answer']) AS engine FROM d)
       GROUP BY ALL),
n AS (SELECT query, engine, count(*) AS n_results FROM res GROUP BY ALL),
r AS (SELECT ok.query, ok.engine, ok.success, coalesce(n.n_results, 0) AS n_results,
             'google_custom' AS original_engine FROM ok LEFT JOIN n USING (query, engine)),
p AS (SELECT *, CASE WHEN success AND n_results > 0 AND engine = original_engine THEN 0
                     WHEN success AND n_results > 0 AND list_position({S.arr(dims.FALLBACK_ENGINES)}, engine) > 0
                          AND engine <> original_engine THEN list_position({S.arr(dims.FALLBACK_ENGINES)}, engine)
                     WHEN engine = original_engine THEN 1000 END AS prio FROM r)
SELECT query, engine, success, n_results, original_engine, engine <> original_engine AS used_fallback
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY prio) AS rn FROM p WHERE prio IS NOT NULL)
WHERE rn = 1
"""

SR = f"""sr AS (
  SELECT page_id, regexp_extract(url, {S.q(LANG_SEGMENT_RE)}, 1) AS query,
         {S.clean_snippet(f"regexp_extract(html, {S.q(TITLE_RE)}, 1)")} AS title, url,
         {S.clean_snippet('html')} AS snippet,
         row_number() OVER (PARTITION BY regexp_extract(url, {S.q(LANG_SEGMENT_RE)}, 1) ORDER BY page_id) AS rank
  FROM pages)"""

A9 = f"""
WITH {SR},
t AS (SELECT * FROM sr WHERE rank <= 10),
l AS (SELECT query, rank, '**' || CAST(row_number() OVER (PARTITION BY query ORDER BY rank, url) AS VARCHAR)
             || '. ' || coalesce(title, 'No title') || '**' || chr(10) || 'URL: ' || coalesce(url, 'No URL')
             || chr(10) || 'Description: ' || coalesce(snippet, 'No description') || chr(10) AS line FROM t)
SELECT query, 'searx' AS engine, CAST(count(*) AS INTEGER) AS n_results,
       'Found ' || count(*) || ' results for ''' || query || ''' (via searx):' || chr(10) || chr(10)
       || string_agg(line, chr(10) ORDER BY rank) AS formatted
FROM l GROUP BY query
"""

F5 = f"""
WITH {SR},
w AS (SELECT page_id, query, rank,
             list_distinct({S.words('lower(query)')}) AS qw, {S.words('lower(title)')} AS tw,
             {S.words('lower(snippet)')} AS sw FROM sr)
SELECT page_id, query,
       round(least(0.5::DOUBLE * len(list_intersect(qw, tw)) / greatest(len(qw), 1)::DOUBLE
                   + 0.3::DOUBLE * len(list_intersect(qw, sw)) / greatest(len(qw), 1)::DOUBLE
                   + 0.2::DOUBLE / greatest(rank, 1), 1.0::DOUBLE), 6) AS relevance
FROM w
"""

_QTYPES = " UNION ALL ".join(
    f"SELECT {S.q(t)} AS qt, {S.arr(e)} AS preferred_engines, {S.arr(m) if m else '[]::VARCHAR[]'} AS modifiers, "
    f"CAST({n} AS INTEGER) AS max_results" for t, e, _d, m, n in dims.QUERY_TYPES)

F11 = f"""
WITH c AS (SELECT conv_id, turn, text AS query,
                  list_extract({S.arr(QUERY_TYPE_CYCLE)}, CAST(turn % {len(QUERY_TYPE_CYCLE)} AS INTEGER) + 1) AS query_type
           FROM conversations WHERE role = 'user'),
qt AS ({_QTYPES}),
e AS (SELECT *, CASE WHEN query_type IN (SELECT qt FROM qt) THEN query_type ELSE 'general' END AS effective_type FROM c)
SELECT conv_id, turn, effective_type,
       CASE WHEN len(modifiers) > 0 THEN concat_ws(' ', query, array_to_string(modifiers, ' ')) ELSE query END
         AS expanded_query,
       max_results, array_to_string(preferred_engines, ',') AS engines
FROM e LEFT JOIN qt ON e.effective_type = qt.qt
"""

_ENGINE = "CASE event_type " + " ".join(f"WHEN {S.q(e)} THEN {S.q(g)}" for e, g in dims.EVENT_ENGINE) \
    + " ELSE 'duckduckgo' END"


def _ttl(key: str, ok: str, ttl_us: int, src: str) -> str:
    """Greedy TTL replay per key as a recursive CTE over the key's rows."""
    return f"""o AS (
  SELECT {key} AS key, event_id, ts, {ok} AS ok,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {src}),
rec AS (
  SELECT key, rn, event_id, ts, false AS hit, CASE WHEN ok THEN ts END AS stored_at FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.event_id, o.ts,
         (rec.stored_at IS NOT NULL AND epoch_us(o.ts) - epoch_us(rec.stored_at) < {ttl_us}) AS hit,
         CASE WHEN rec.stored_at IS NOT NULL AND epoch_us(o.ts) - epoch_us(rec.stored_at) < {ttl_us}
              THEN rec.stored_at WHEN o.ok THEN o.ts ELSE rec.stored_at END AS stored_at
  FROM rec JOIN o ON o.key = rec.key AND o.rn = rec.rn + 1)"""


H_KEY = "md5(event_type || ':' || '10')"

H2 = f"WITH RECURSIVE {_ttl(H_KEY, chr(40) + 'event_type <> ' + S.q('error') + chr(41), 3600 * 10**6, 'events')} " \
     "SELECT key, event_id, hit, stored_at FROM rec"

H3 = f"WITH RECURSIVE {_ttl(H_KEY, chr(40) + 'event_type <> ' + S.q('error') + chr(41), 3600 * 10**6, 'events')} " \
     "SELECT key, max(stored_at) AS stored_at FROM rec WHERE stored_at IS NOT NULL GROUP BY key " \
     "ORDER BY stored_at DESC, key LIMIT 100"

H4 = f"WITH RECURSIVE {_ttl(H_KEY, chr(40) + 'event_type <> ' + S.q('error') + chr(41), 3600 * 10**6, 'events')} " \
     "SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS hits, " \
     "CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE hit) / count(*) ELSE 0.0 END AS hit_rate FROM rec"

_DOM = f"list_extract({S.arr(dims.PRESET_DOMAINS)}, CAST(user_id % {len(dims.PRESET_DOMAINS)} AS INTEGER) + 1)"

G4 = f"WITH RECURSIVE rl AS (SELECT event_id, ts, {_DOM} || ':' || '*' AS rkey FROM events), " \
     f"{_ttl('rkey', 'true', 3600 * 10**6, 'rl')} SELECT key, event_id, NOT hit AS refetch FROM rec"

ORACLE = {
    "A3_parse_google_payloads": A3,
    "A4_parse_searx_payloads": A4,
    "A5_parse_bing_payloads": A5,
    "A6_parse_instant_answers": A6,
    "A9_format_results": A9,
    "F5_relevance": F5,
    "F7_engine_fallback": F7,
    "F11_expand_queries": F11,
    "F12_valid_results": F12,
    "F13_normalize_results": F13,
    "H2_cache_hits": H2,
    "H3_cache_evict": H3,
    "H4_cache_hit_rate": H4,
    "G4_robots_refresh_points": G4,
}

A7 = f"""
WITH {SR}
SELECT query, CAST(1 AS INTEGER) AS rank, {S.clean_snippet('title')} AS title, url,
       {S.clean_snippet('snippet')} AS snippet
FROM sr WHERE {S.clean_snippet('title')} <> ''
"""


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


_TITLE_RAW = _unescape(f"regexp_extract(html, {S.q(TITLE_RE)}, 1)")

D3 = f"""
SELECT page_id, CASE WHEN length(t) BETWEEN 5 AND 200 THEN {S.fold_ascii('t')} END AS title
FROM (SELECT page_id, trim({_TITLE_RAW}) AS t FROM pages)
"""

ORACLE.update({"A7_parse_serp_html": A7, "D3_titles": D3})

from checks.oracle_logs import ROBOTS  # noqa: E402

F9 = f"""
WITH {ROBOTS},
u AS (SELECT page_id, {S.two_label_domain(S.url_host('n'))} AS domain, {S.url_path('n')} AS path
      FROM (SELECT page_id, {S.canonical_url('url')} AS n FROM pages)),
r AS (SELECT * FROM rules WHERE agent IN ('webspinbot', '*')),
f AS (SELECT page_id, bool_or(kind = 'allow') AS a, bool_or(kind = 'disallow') AS dd
      FROM u JOIN r ON u.domain = r.domain AND (
           r.prefix = '/' OR CASE WHEN ends_with(r.prefix, '*')
                                  THEN starts_with(u.path, left(r.prefix, length(r.prefix) - 1))
                                  ELSE starts_with(u.path, r.prefix) END)
      GROUP BY page_id),
al AS (SELECT u.page_id, coalesce(f.a, false) OR NOT coalesce(f.dd, false) AS allowed
       FROM u LEFT JOIN f USING (page_id)),
recs AS (SELECT page_id, {S.canonical_url('url')} AS normalized_url,
                {S.clean_snippet(f"regexp_extract(html, {S.q(TITLE_RE)}, 1)")} AS content FROM pages),
pa AS (SELECT recs.normalized_url, recs.content, al.allowed FROM recs LEFT JOIN al USING (page_id)
       WHERE page_id IN (SELECT min(page_id) FROM recs GROUP BY normalized_url)),
{SR[:-1]}),
res AS (SELECT query, CAST(rank AS INTEGER) AS rank, {S.canonical_url('url')} AS normalized_url FROM sr)
SELECT res.query, res.rank, res.normalized_url,
       (CASE WHEN NOT coalesce(NOT pa.allowed, false) THEN pa.content END) IS NOT NULL AS has_content,
       coalesce(NOT pa.allowed, false) AS robots_blocked
FROM res LEFT JOIN pa USING (normalized_url)
"""

ORACLE["F9_enrich_results"] = F9

A7_TOOL = f"""
WITH {SR}
SELECT query, CAST(1 AS INTEGER) AS rank, left(title, 200) AS title,
       '/l/?kh=-1&uddg=' || {S.quote_plus('url')} AS url, left(trim(snippet), 300) AS snippet
FROM sr WHERE title <> ''
"""

A7_BING = f"""
WITH {SR}
SELECT query, CAST(1 AS INTEGER) AS rank, left(title, 200) AS title, url, left(trim(snippet), 300) AS snippet
FROM sr
"""

ORACLE.update({"A7_parse_serp_html_tool": A7_TOOL, "A7_parse_serp_html_bing": A7_BING})

_CHAIN = ["instant_answer", "duckduckgo_html", "searx", "bing"]

F7_CHAIN = f"""
WITH {PARSED},
i AS (SELECT query, 'instant_answer' AS engine, (CASE WHEN doc_id % 3 = 0 AND coalesce(text, '') <> '' THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(title || ' - ' || source, '') <> '' THEN 1 ELSE 0 END) AS k FROM d),
n AS (SELECT query, engine, count(*) AS n_results FROM res GROUP BY ALL
      UNION ALL SELECT query, engine, CAST(sum(k) AS BIGINT) FROM i WHERE split_part(query, ':', -1) IN ('en', 'fr') GROUP BY ALL),
p AS (SELECT *, list_position({S.arr(_CHAIN)}, engine) AS pos FROM n WHERE n_results > 0 AND list_position({S.arr(_CHAIN)}, engine) > 0)
SELECT query, engine, n_results, pos > 1 AS used_fallback FROM p
QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) = 1
"""

F7_MIRROR = f"""
WITH {PARSED},
a AS (SELECT query, CAST(CAST(split_part(url, '/', -1) AS BIGINT) % 3 AS INTEGER) AS mirror,
             CASE split_part(query, ':', -1) WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 0 END AS down FROM x),
gm AS (SELECT query, mirror, count(*) FILTER (WHERE mirror >= down) AS n_results FROM a GROUP BY ALL)
SELECT query, min(mirror) FILTER (WHERE n_results > 0) AS mirror, coalesce(arg_min(n_results, mirror) FILTER (WHERE n_results > 0), 0) AS n_results
FROM gm GROUP BY query
"""

ORACLE.update({"F7_tool_chain": F7_CHAIN, "F7_first_mirror": F7_MIRROR})
