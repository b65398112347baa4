"""DuckDB oracle SQL for the text, quality and corpus queries."""

from __future__ import annotations

from checks import sqlparts as S
from webspin import dims
from webspin.functions import text as X
from webspin.operators import quality as Q
from webspin.operators import text as T

C1 = f"""
SELECT doc_id, md5({S.fold_ascii('text')}) AS clean_ascii_md5, {S.word_count('text')} AS words
FROM documents
"""

C2 = f"""
SELECT page_id, length(s) AS snippet_len, md5(s) AS snippet_md5
FROM (SELECT page_id, {S.clean_snippet('html')} AS s FROM pages)
"""

C4 = f"""
SELECT doc_id, a AS ascii_text, length(a) AS ascii_len
FROM (SELECT doc_id, {S.fold_ascii('text')} AS a FROM documents)
"""

C5 = f"""
SELECT count(*) AS n_copies, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id, {S.fold_ascii('text')} AS a FROM documents)
WHERE a <> '' GROUP BY md5(a) HAVING count(*) > 1
"""

C6 = f"""
SELECT doc_id, words,
       CASE WHEN coalesce(text, '') = '' THEN 0
            ELSE CAST(greatest(1, round_even(words / 200.0, 0)) AS INTEGER) END AS reading_minutes
FROM (SELECT doc_id, text, {S.word_count('text')} AS words FROM documents)
"""

C7 = f"""
SELECT doc_id, lang, {S.detect_language('text', 'page')} AS detected_page,
       {S.detect_language('text', 'text')} AS detected_text
FROM documents
"""

C8 = f"""
SELECT lang, {S.detect_language('text', 'page')} AS detected, count(*) AS n
FROM documents GROUP BY ALL
"""


def _low_line(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {S.q(p)})"
                             for p in X.PORTABLE_LOW_QUALITY_LINE_PATTERNS) + ")"


C9 = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_filter(lines, lambda ln: NOT {_low_line('lower(trim(ln))')}) AS kept FROM l)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines,
       CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped,
       length(array_to_string(kept, chr(10))) AS kept_len
FROM k
"""

C10 = f"""
WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {S.q(T.SENTENCE_SPLIT)}) AS sents
           FROM documents),
k AS (SELECT doc_id, sents, list_filter(sents, lambda x: length(x) >= 10 AND length(x) <= 1000) AS kept FROM s)
SELECT doc_id, CAST(len(sents) AS INTEGER) AS n_sentences, CAST(len(kept) AS INTEGER) AS n_kept,
       length(array_to_string(kept, '. ')) AS kept_len
FROM k
"""

C11 = f"""
SELECT doc_id,
       CAST(len(regexp_extract_all(t, {S.q(T.URL_RE)})) AS INTEGER) AS n_urls,
       CAST(len(regexp_extract_all(t, {S.q(T.EMAIL_RE)})) AS INTEGER) AS n_emails,
       length(regexp_replace(regexp_replace(t, {S.q(T.URL_RE)}, '', 'g'), {S.q(T.EMAIL_RE)}, '', 'g')) AS masked_len
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

C12 = f"""
SELECT conv_id, turn, left(text, {T.FIELD_CAPS['source']}) AS as_source,
       left(text, {T.FIELD_CAPS['observation']}) AS as_observation,
       left(text, {T.FIELD_CAPS['tool_input']}) AS as_tool_input
FROM conversations
"""

E1 = f"SELECT doc_id, round({S.quality_score('text')}, 6) AS quality FROM documents"


def _valid(x: str) -> str:
    t = f"coalesce({x}, '')"
    return (f"(length({S.strip_ws(t)}) >= 10 "
            f"AND NOT regexp_matches(lower({t}), {S.q('|'.join(X.INVALID_PATTERNS))}))")


E2 = f"SELECT doc_id, {_valid('text')} AS valid FROM documents"


def url_page_type(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    whens = " ".join(
        f"WHEN " + " OR ".join(f"contains({low}, {S.q(s)})" for s in subs) + f" THEN {S.q(pt)}"
        for pt, subs in Q.URL_TYPE_PATTERNS)
    return f"(CASE {whens} ELSE NULL END)"


_RULES = " UNION ALL ".join(f"SELECT {S.q(t)} AS page_type, {m} AS min_len, {th} AS thr"
                            for t, m, th in dims.PAGE_TYPE_RULES)

E3 = f"""
WITH d AS (
  SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, coalesce(text, '') AS body,
         coalesce({url_page_type('source')}, 'article') AS page_type
  FROM documents),
r AS ({_RULES})
SELECT doc_id, d.page_type,
       (title <> '' AND body <> '' AND length(body) >= r.min_len
        AND {S.quality_score('body')} >= r.thr) AS extraction_success
FROM d LEFT JOIN r ON d.page_type = r.page_type
"""

E4 = "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) BETWEEN 100 AND 50000"

E5 = f"""
WITH s AS (SELECT doc_id, source, round({S.quality_score('text')}, 6) AS quality FROM documents),
j AS (SELECT s.*, CAST(round(s.quality * 1000000) AS BIGINT) AS micro, l.quality AS label_quality
      FROM s LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS n_docs,
       sum(micro) / count(*) / 1000000.0::DOUBLE AS avg_quality,
       round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality,
       count(*) FILTER (WHERE quality >= 0.6) AS n_pass,
       count(label_quality) AS n_labeled,
       count(*) FILTER (WHERE label_quality = 1) AS n_label_good,
       CASE WHEN count(*) FILTER (WHERE label_quality = 1) > 0 THEN
         sum(micro) FILTER (WHERE label_quality = 1) / count(*) FILTER (WHERE label_quality = 1)
         / 1000000.0::DOUBLE END AS avg_quality_label_good,
       CASE WHEN count(*) FILTER (WHERE label_quality = 0) > 0 THEN
         sum(micro) FILTER (WHERE label_quality = 0) / count(*) FILTER (WHERE label_quality = 0)
         / 1000000.0::DOUBLE END AS avg_quality_label_bad
FROM j GROUP BY source
"""

D2 = f"""
SELECT page_id, coalesce({url_page_type('url')},
  CASE WHEN regexp_matches(coalesce(html, ''), {S.q(Q.ARTICLE_TAG_RE)}) THEN 'article'
       WHEN regexp_matches(coalesce(html, ''), {S.q(Q.ARTICLE_CLASS_RE)}) THEN 'article'
       WHEN regexp_matches(coalesce(html, ''), {S.q(Q.DOC_CLASS_RE)}) THEN 'documentation'
       ELSE 'article' END) AS page_type
FROM pages
"""

X12 = f"""
WITH s AS (
  SELECT doc_id, source, text, round({S.quality_score('text')}, 6) AS quality FROM documents
  WHERE {_valid('text')} AND length(text) BETWEEN 100 AND 50000)
SELECT doc_id, source, quality, length(text) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY md5({S.fold_ascii('text')}) ORDER BY doc_id) AS rn
  FROM s WHERE quality >= 0.5) WHERE rn = 1
"""

_BIN = "CAST(least(floor(quality * 10), 9) AS INTEGER) AS bin"
E5_SOURCE = f"""
SELECT source, {_BIN}, count(*) AS n FROM (SELECT source, round({S.quality_score('text')}, 6) AS quality FROM documents) GROUP BY ALL
"""
E5_TYPE = f"""
WITH t AS ({D2}), s AS (SELECT page_id, {S.clean_snippet('html')} AS text FROM pages)
SELECT page_type, {_BIN}, count(*) AS n FROM (SELECT page_type, round({S.quality_score('text')}, 6) AS quality FROM t JOIN s USING (page_id)) GROUP BY ALL
"""

ORACLE = {
    "C1_clean_text": C1,
    "C2_clean_snippets": C2,
    "C4_fold_ascii": C4,
    "C5_exact_duplicates": C5,
    "C6_reading_stats": C6,
    "C7_detect_language": C7,
    "C8_language_mix": C8,
    "C9_drop_low_quality_lines": C9,
    "C10_bound_sentences": C10,
    "C11_mask_urls_emails": C11,
    "C12_truncate_fields": C12,
    "E1_quality_scores": E1,
    "E2_valid_content": E2,
    "E3_validate_extraction": E3,
    "E4_length_window": E4,
    "E5_quality_report": E5,
    "E5_source_histogram": E5_SOURCE,
    "E5_page_type_histogram": E5_TYPE,
    "D2_page_types": D2,
    "X12_curate_corpus": X12,
    "A10_write_corpus": X12,
}
