"""DuckDB oracle SQL for the native parts of the DOM jobs (D5 blocks, D12)."""

from __future__ import annotations

from checks import sqlparts as S
from webspin.operators import html as H
from webspin.plans.catalog_html import P_BLOCK_RE

D5 = f"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, {S.q(P_BLOCK_RE)}, 1)) AS raw,
                  unnest(range(len(regexp_extract_all(html, {S.q(P_BLOCK_RE)}, 1)))) AS block_no FROM pages),
t AS (SELECT page_id, block_no, {S.clean_snippet('raw')} AS text FROM b),
s AS (SELECT page_id, block_no,
             round(least(greatest(
               (CASE WHEN length(text) > 100 THEN least(length(text) / 1000.0::DOUBLE, 0.4::DOUBLE) ELSE 0.0::DOUBLE END)
               + (CASE WHEN n > 3 THEN least(n / 50.0::DOUBLE, 0.2::DOUBLE) ELSE 0.0::DOUBLE END), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score
      FROM (SELECT *, (len(string_split(text, '. ')) - 1) + (len(string_split(text, '? ')) - 1)
                      + (len(string_split(text, '! ')) - 1) AS n FROM t))
SELECT page_id, CAST(block_no AS INTEGER) AS block_no, score,
       row_number() OVER (PARTITION BY page_id ORDER BY score DESC, block_no) = 1 AS is_best
FROM s
"""

HOSTS = [*H.DOMAIN_RULES, "en.wikipedia.org"]


def _rule_rows() -> str:
    rows = []
    general = {**H.RULES, H.HEADLINES: (H.HEURISTIC_TITLE, ["text"], 6, 1 << 30), H.BLOCKS: (H.HEURISTIC_CONTENT, ["text"], 101, 1 << 30)}
    for domain, fields in [("*", general), *H.DOMAIN_RULES.items()]:
        for field, (selectors, attributes, lo, hi) in fields.items():
            for i, x in enumerate(selectors):
                around, _, own = x.replace('"', "'").rpartition(" ")
                rows.append(f"({S.q(domain)}, {S.q(field)}, {i}, {S.q(own)}, {S.q(around) if around else 'NULL'}, {S.q(','.join(attributes))}, {lo}, {hi})")
    rows.append(f"('*', {S.q(H.BLOCKS)}, {len(H.HEURISTIC_CONTENT)}, 'div', NULL, 'text', 201, {1 << 30})")
    return ", ".join(rows)


D12 = f"""
WITH r(domain, field, pos, selector, around, attributes, min_len, max_len) AS (VALUES {_rule_rows()}),
p AS (SELECT page_id, regexp_extract(CASE WHEN page_id % 2 = 0 THEN 'https://www.' || list_extract({S.arr(HOSTS)}, CAST(page_id % {len(HOSTS)} AS INTEGER) + 1) || '/a' ELSE url END,
                                     'https?://(?:www\\.)?([^/]+)', 1) AS host FROM pages)
SELECT page_id, host, field, pos, selector, around, attributes, min_len, max_len FROM p JOIN r
  ON r.domain = p.host OR (r.domain = '*' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.domain = p.host AND o.field = r.field))
"""

D7 = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Writer ' || (page_id % 7) ELSE '' END AS author FROM pages"
D8 = """
SELECT page_id, publish_date, CAST(CASE WHEN page_id % 4 = 0 THEN strptime(publish_date, '%Y-%m-%d') WHEN page_id % 4 = 1 THEN strptime(publish_date, '%m/%d/%Y') END AS TIMESTAMP) AS published_at
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-03-0' || (page_id % 9 + 1) WHEN 1 THEN '3/' || (page_id % 27 + 1) || '/2024' ELSE '' END AS publish_date FROM pages)
"""
D9 = """
SELECT keyword, count(*) AS n FROM (SELECT unnest(['alpha', 'topic' || (page_id % 5)]) AS keyword FROM pages WHERE page_id % 2 = 0) GROUP BY keyword
"""
D10 = "SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || '/p/' || (page_id % 10) AS link FROM pages"
D11 = "SELECT page_id, CAST(page_id % 2 AS INTEGER) AS n_images FROM pages"

ORACLE = {"D5_score_blocks": D5, "D7_authors": D7, "D8_publish_dates": D8, "D9_keyword_counts": D9, "D10_page_links": D10, "D11_page_images": D11, "D12_rules_for": D12}
