"""DuckDB SQL fragments that mirror the Spark column expressions. Used only
to build the oracle SQL strings of ``__spark_entry__.oracle_sql``; the fixed
word lists are imported from the library so both sides share one copy."""

from __future__ import annotations

from webspin.functions import text as X
from webspin.functions import urls as U

WS_RUN = X.WS_RUN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(WS_RUN)}), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS INTEGER)"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(WS_RUN)}, ' ', 'g')"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def clean_snippet(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')"
    t = strip_ws(collapse_ws(t))
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'")):
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return t


def clean_text_no_nfkd(x: str) -> str:
    no_ctrl = f"regexp_replace({x}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')"
    return f"coalesce({strip_ws(collapse_ws(no_ctrl))}, '')"


def fold_ascii(x: str) -> str:
    """C4 oracle: accents stripped instead of NFKD, then the same tail."""
    c = clean_text_no_nfkd(x)
    folded = f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]+', '', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {strip_ws(folded)} END"


def count_contained(low: str, phrases) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({low}, {q(p)}) THEN 1 ELSE 0 END)"
                            for p in phrases) + ")"


def quality_score(x: str) -> str:
    t = f"coalesce({x}, '')"
    w = f"CAST({word_count(t)} AS DOUBLE)"
    s = f"CAST(length({t}) - length(replace({t}, '.', '')) + 1 AS DOUBLE)"
    length_score = f"(CASE WHEN {w} < 50 THEN {w} / 50.0 WHEN {w} > 10000 THEN 10000.0 / {w} ELSE 1.0 END)"
    sentence = f"least({w} / {s} / 20.0, 1.0)"
    low = f"lower({t})"
    qn = f"CAST({count_contained(low, X.QUALITY_PHRASES)} AS DOUBLE)"
    mn = f"CAST({count_contained(low, X.SPAM_PHRASES)} AS DOUBLE)"
    unique = f"greatest(0.0, ({qn} - {mn} * 2.0) / greatest({qn} + {mn}, 1.0))"
    readable = f"least({s} / greatest({w} / 100.0, 1.0), 1.0)"
    total = f"({length_score} * 0.2 + {sentence} * 0.3 + {readable} * 0.2 + {unique} * 0.3)"
    return f"(CASE WHEN {t} = '' THEN 0.0 ELSE least(greatest({total}, 0.0), 1.0) END)"


def detect_language(x: str, mode: str = "page") -> str:
    t = f"coalesce({x}, '')"
    if mode == "page":
        min_len, n, es, en, floor = 50, 200, X.PAGE_SPANISH_WORDS, X.PAGE_ENGLISH_WORDS, 5
    else:
        min_len, n, es, en, floor = 20, 100, X.TEXT_SPANISH_WORDS, X.TEXT_ENGLISH_WORDS, None
    first = f"list_slice({words('lower(' + t + ')')}, 1, {n})"
    n_es = f"len(list_filter({first}, lambda w: list_contains({arr(es)}, w)))"
    n_en = f"len(list_filter({first}, lambda w: list_contains({arr(en)}, w)))"
    if floor is None:
        guess = (f"CASE WHEN {n_es} > {n_en} THEN 'spanish' WHEN {n_en} > {n_es} "
                 f"THEN 'english' ELSE 'unknown' END")
    else:
        guess = (f"CASE WHEN {n_es} > {n_en} AND {n_es} > {floor} THEN 'spanish' "
                 f"WHEN {n_en} > {n_es} AND {n_en} > {floor} THEN 'english' ELSE 'unknown' END")
    return f"(CASE WHEN length({t}) < {min_len} THEN 'unknown' ELSE {guess} END)"


# ---- URLs ---------------------------------------------------------------

_S = "(?s)"


def with_scheme(x: str) -> str:
    u = f"coalesce({x}, '')"
    pre = (f"(CASE WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') "
           f"THEN {u} ELSE 'https://' || {u} END)")
    return f"regexp_replace({pre}, '[\\t\\r\\n]', '', 'g')"


def split_url(u: str) -> dict[str, str]:
    netloc = f"regexp_extract({u}, {q(_S + '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)')}, 1)"
    rest = f"regexp_extract({u}, {q(_S + '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$')}, 1)"
    no_frag = f"regexp_extract({rest}, {q(_S + '^([^#]*)')}, 1)"
    path = f"regexp_extract({no_frag}, {q(_S + '^([^?]*)')}, 1)"
    query = f"regexp_extract({no_frag}, {q(_S + '^[^?]*[?](.*)$')}, 1)"
    path = f"regexp_replace({path}, {q(_S + ';[^/]*$')}, '')"
    return {"netloc": netloc, "path": path, "query": query}


def quote_plus(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def form_decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def filter_query(query: str) -> str:
    pairs = f"list_filter(string_split({query}, '&'), lambda p: instr(p, '=') > 0)"
    kv = (f"list_transform({pairs}, lambda p: {{'k': {form_decode('split_part(p, chr(61), 1)')}, "
          f"'v': {form_decode('substr(p, instr(p, chr(61)) + 1)')}}})")
    kv = f"list_filter({kv}, lambda s: length(s.v) > 0)"
    kv = (f"list_filter({kv}, lambda s: NOT list_contains({arr(U.TRACKING_PARAMS)}, lower(s.k)) "
          f"AND NOT starts_with(s.k, '_'))")
    # group repeated keys at their first position
    grouped = (f"list_transform(list_sort(list_transform(list_zip({kv}, range(1, len({kv}) + 1)), "
               f"lambda z: {{'first': list_position(list_transform({kv}, lambda s: s.k), z[1].k), "
               f"'pos': z[2], 'k': z[1].k, 'v': z[1].v}})), "
               f"lambda s: {quote_plus('s.k')} || '=' || {quote_plus('s.v')})")
    return f"array_to_string({grouped}, '&')"


def canonical_url(x: str) -> str:
    u = with_scheme(x)
    p = split_url(u)
    host0 = f"lower({p['netloc']})"
    host = f"(CASE WHEN starts_with({host0}, 'www.') THEN substr({host0}, 5) ELSE {host0} END)"
    path = p["path"]
    path = (f"(CASE WHEN ends_with({path}, '/') AND length({path}) > 1 "
            f"THEN left({path}, length({path}) - 1) ELSE {path} END)")
    fq = filter_query(p["query"])
    norm = f"('https://' || {host} || {path} || CASE WHEN {fq} <> '' THEN '?' || {fq} ELSE '' END)"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {norm} END)"


def url_host(n: str) -> str:
    return f"regexp_extract({n}, {q(_S + '^https://([^/?#]*)')}, 1)"


def url_path(n: str) -> str:
    return split_url(n)["path"]


def two_label_domain(h: str) -> str:
    n = f"(length({h}) - length(replace({h}, '.', '')) + 1)"
    return (f"(CASE WHEN {n} >= 2 THEN array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.') "
            f"ELSE {h} END)")


def subdomain(h: str) -> str:
    n = f"(length({h}) - length(replace({h}, '.', '')) + 1)"
    return (f"(CASE WHEN {n} > 2 THEN left({h}, length({h}) - length({two_label_domain(h)}) - 1) "
            f"ELSE '' END)")


def url_hash(n: str) -> str:
    return f"left(md5({n}), 12)"


def host_of(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), 'https?://(?:www\\.)?([^/]+)', 1)"
