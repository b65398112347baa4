"""DuckDB oracle SQL for the flagship, URL and link queries."""

from __future__ import annotations

from checks import sqlparts as S
from webspin.operators.urls import _A_HREF
from webspin.plans.flagship import TITLE_RE

_snip = S.clean_snippet("html")

FLAGSHIP = f"""
WITH rec AS (
  SELECT page_id, {S.canonical_url('url')} AS normalized_url, html FROM pages
), rec2 AS (
  SELECT page_id, normalized_url, {S.url_host('normalized_url')} AS host,
         {S.clean_snippet(f"regexp_extract(html, {S.q(TITLE_RE)}, 1)")} AS title,
         round({S.quality_score(_snip)}, 6) AS quality,
         {S.word_count(_snip)} AS words
  FROM rec
)
SELECT page_id, normalized_url, host, {S.two_label_domain('host')} AS domain,
       {S.url_hash('normalized_url')} AS url_hash, title, quality, words, host_rank
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY quality DESC, page_id) AS host_rank
      FROM rec2)
WHERE host_rank <= 10
"""

U1 = f"SELECT page_id, url, {S.canonical_url('url')} AS normalized_url FROM pages"

_query_of_url = S.split_url(S.with_scheme("url"))["query"]
_raw_query = f"regexp_extract(regexp_extract(url, '(?s)^[^#]*', 0), '(?s)^[^?]*[?](.*)$', 1)"

U2_REPORT = f"""
WITH p AS (SELECT unnest(string_split({_raw_query}, '&')) AS pair FROM pages),
k AS (SELECT {S.form_decode("split_part(pair, '=', 1)")} AS param FROM p WHERE instr(pair, '=') > 0)
SELECT param,
       (list_contains({S.arr(S.U.TRACKING_PARAMS)}, lower(param)) OR starts_with(param, '_')) AS dropped,
       count(*) AS n
FROM k GROUP BY ALL
"""

U2_CLEAN = f"""
SELECT page_id, {_raw_query} AS query, {S.filter_query(_raw_query)} AS clean_query FROM pages
"""

U3 = f"""
WITH n AS (SELECT page_id, {S.canonical_url('url')} AS normalized_url FROM pages),
h AS (SELECT *, {S.url_host('normalized_url')} AS host FROM n)
SELECT page_id, normalized_url, {S.two_label_domain('host')} AS domain,
       {S.subdomain('host')} AS subdomain, {S.url_path('normalized_url')} AS path,
       CAST(len(list_distinct(list_transform(list_filter(string_split({S.split_url('normalized_url')['query']}, '&'),
            lambda p: instr(p, '=') > 0 AND length(p) > instr(p, '=')),
            lambda p: {S.form_decode("split_part(p, '=', 1)")}))) AS INTEGER) AS n_params,
       starts_with(normalized_url, 'https://') AS is_secure,
       {S.url_hash('normalized_url')} AS url_hash
FROM h
"""

U4 = f"SELECT page_id, url, {S.host_of('url')} AS host FROM pages"

HREFS = f"""hrefs AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {S.q(_A_HREF)}, 1)) AS href FROM pages
)"""


def _valid(x: str, strict: bool = False) -> str:
    u = f"regexp_replace(regexp_replace(coalesce({x}, ''), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    pat = "(?s)^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]" if strict else "(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"
    return f"regexp_matches({u}, {S.q(pat)})"


U5 = f"""
WITH {HREFS},
cand AS (SELECT page_id, url AS candidate FROM pages UNION ALL SELECT page_id, href FROM hrefs)
SELECT page_id, count(*) AS n,
       count(*) FILTER (WHERE {_valid('candidate')}) AS n_loose,
       count(*) FILTER (WHERE {_valid('candidate', True)}) AS n_strict
FROM cand GROUP BY page_id
"""

U6 = f"""
SELECT page_id, '/l/?kh=-1&uddg=' || {S.quote_plus('url')} AS wrapped, url AS unwrapped FROM pages
"""


def _unescape(x: str) -> str:
    for ent, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&amp;", "&")):
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


def _resolve(base: str, href: str) -> str:
    """Oracle join for the forms in the data: absolute, '//host', '/path'."""
    scheme = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    netloc = S.split_url(base)["netloc"]
    return (f"(CASE WHEN starts_with({href}, 'http://') OR starts_with({href}, 'https://') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN starts_with({href}, '/') THEN {scheme} || '://' || {netloc} || {href} "
            f"ELSE NULL END)")


U7 = f"""
WITH {HREFS}
SELECT page_id, href, link FROM (
  SELECT page_id, href, {_resolve('url', 'href')} AS link FROM hrefs)
WHERE {_valid('link', True)}
"""

U8 = f"""
WITH n AS (SELECT page_id, {S.canonical_url('url')} AS normalized_url FROM pages),
h AS (SELECT *, {S.url_hash('normalized_url')} AS url_hash FROM n)
SELECT page_id, normalized_url, url_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY page_id) AS rn FROM h) WHERE rn = 1
"""

LINKS = f"""{HREFS},
links AS (
  SELECT DISTINCT page_id, url, link FROM (
    SELECT page_id, url, {_resolve('url', _unescape('href'))} AS link FROM hrefs)
  WHERE {_valid('link')}
)"""

D10_RAW = f"WITH {LINKS} SELECT page_id, link FROM links"

EDGES = f"""{LINKS},
edges AS (SELECT page_id, {S.canonical_url('url')} AS src_url, {S.canonical_url('link')} AS dst_url FROM links)"""

X10 = f"""
WITH {EDGES},
fetched AS (SELECT {S.canonical_url('url')} AS dst_url FROM pages)
SELECT dst_url, count(*) AS n_refs, count(DISTINCT page_id) AS n_pages
FROM edges WHERE dst_url NOT IN (SELECT dst_url FROM fetched WHERE dst_url IS NOT NULL)
GROUP BY dst_url
"""

X11 = f"""
WITH {EDGES}
SELECT {S.url_host('src_url')} AS src_host, {S.url_host('dst_url')} AS dst_host,
       count(*) AS n_links, count(DISTINCT page_id) AS n_pages
FROM edges GROUP BY ALL
"""

X11_IN = f"""
WITH {EDGES}
SELECT {S.url_host('dst_url')} AS dst_host, count(DISTINCT {S.url_host('src_url')}) AS in_hosts, count(*) AS in_links
FROM edges GROUP BY ALL
"""

ORACLE = {
    "flagship_best_pages": FLAGSHIP,
    "U1_canonicalize_urls": U1,
    "U2_tracking_param_report": U2_REPORT,
    "U2_strip_tracking_params": U2_CLEAN,
    "U3_url_parts": U3,
    "U4_host_of": U4,
    "U5_valid_urls": U5,
    "U6_unwrap_redirects": U6,
    "U7_resolve_links": U7,
    "U8_dedupe_urls": U8,
    "D10_raw_page_links": D10_RAW,
    "X10_crawl_frontier": X10,
    "X11_link_graph": X11,
    "X11_host_in_degree": X11_IN,
}

_REL = "regexp_replace(url, '^https?:', '')"
_REDIR = f"'https://duckduckgo.com/l/?uddg=' || {S.quote_plus('url')} || '&rut=x'"
_PATH = S.url_path(S.canonical_url("url"))


def _clean_result(x: str) -> str:
    t = f"regexp_extract({x}, 'uddg=([^&]+)', 1)"
    return (f"(CASE WHEN {x} = '' THEN '' WHEN {t} <> '' THEN url_decode(replace({t}, '+', '%2B')) "
            f"WHEN starts_with({x}, '//') THEN 'https:' || {x} WHEN starts_with({x}, '/') THEN '' ELSE {x} END)")


U6_CLEAN = f"""
WITH f AS (SELECT page_id, 'protocol_relative' AS form, {_REL} AS raw FROM pages
           UNION ALL SELECT page_id, 'redirect', {_REDIR} FROM pages
           UNION ALL SELECT page_id, 'relative', {_PATH} FROM pages)
SELECT page_id, form, raw, {_clean_result('raw')} AS cleaned FROM f
"""

A1 = """
SELECT 'pages' AS table_name, count(*) AS n_rows FROM pages
UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'benchmark', count(*) FROM benchmark
UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'events', count(*) FROM events
"""

ORACLE.update({"U6_clean_result_urls": U6_CLEAN, "A1_load_tables": A1})
