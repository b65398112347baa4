"""Column expressions for text work (C1-C12, E1, E2). Native Catalyst except
Unicode NFKD, which Spark lacks: one Arrow-batched pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's whitespace set (str.split() / re \s on str). Java's \s is ASCII-only,
# so the class is spelled out; the same text works in RE2 (DuckDB).
WS_CLASS = ("[\\t\\n\\x{0B}\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}"
            "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
WS_RUN = WS_CLASS + "+"          # RE2 spelling (oracle SQL)
# Java spelling of the same set: (?U)\s is Unicode White_Space; Python adds
# the four separators U+001C..U+001F. About 3x faster than the explicit class.
J_WS_RUN = "(?U)[\\s\\x1c-\\x1f]+"
J_NON_WS_RUN = "(?U)[^\\s\\x1c-\\x1f]+"
J_STRIP = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"

# Fixed values that must equal the reference (quality scoring, E1).
QUALITY_PHRASES = (
    "research", "study", "analysis", "data", "evidence",
    "conclusion", "methodology", "results", "findings",
    "according", "however", "therefore", "furthermore",
)
SPAM_PHRASES = (
    "click here", "buy now", "limited time", "act fast",
    "amazing deal", "free download", "make money",
    "lose weight", "miracle", "secret",
)

# Fixed values that must equal the reference (invalid-content patterns, E2).
INVALID_PATTERNS = (
    "404 not found",
    "page not found",
    "access denied",
    "javascript required",
    "cookies required",
    "please enable javascript",
    "this site requires cookies",
    "captcha",
    "robot",
    "bot detection",
)

# Fixed values that must equal the reference (low-quality line patterns, C9).
LOW_QUALITY_LINE_PATTERNS = (
    r"^(click here|read more|continue reading)\.?$",
    r"^(home|menu|search|login|register)$",
    r"^\d+$",
    r"^[^\w\s]+$",
)

# Fixed values that must equal the reference (language word lists, C7).
PAGE_SPANISH_WORDS = ("el", "la", "de", "que", "y", "en", "un", "es", "se", "no",
                      "te", "lo", "le", "da", "su", "por", "son", "con", "para", "al")
PAGE_ENGLISH_WORDS = ("the", "of", "and", "to", "a", "in", "is", "it", "you", "that",
                      "he", "was", "for", "on", "are", "as", "with", "his", "they", "i")
TEXT_SPANISH_WORDS = ("el", "la", "de", "que", "y", "es", "en", "un", "se", "no")
TEXT_ENGLISH_WORDS = ("the", "of", "and", "to", "a", "in", "is", "it", "you", "that")


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Keeps one evaluation of an expensive sub-expression (split, lower) when
    the body refers to it many times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _nfkd_pandas(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x) if isinstance(x, str) else x)


try:  # Arrow-native UDF: whole batches normalised in C++ (utf8proc)
    import pyarrow as pa
    import pyarrow.compute as pc

    @F.arrow_udf(T.StringType())
    def nfkd(a: pa.Array) -> pa.Array:
        """Unicode NFKD: the one text step with no Catalyst function."""
        return pc.utf8_normalize(a, form="NFKD")
except (AttributeError, ImportError):  # older PySpark: Arrow-batched pandas UDF
    nfkd = F.pandas_udf(_nfkd_pandas, T.StringType())


def words(c: Column) -> Column:
    """str.split(): whitespace split without empty pieces."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), J_WS_RUN), lambda w: w != "")


def word_count(c: Column) -> Column:
    """len(str.split()): number of maximal non-whitespace runs."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(J_NON_WS_RUN))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, J_WS_RUN, " ")


J_LEAD = "(?U)^[\\s\\x1c-\\x1f]+"


def strip_ws(c: Column) -> Column:
    """str.strip(): both ends anchored at the start (the end via reverse),
    so no unanchored end-of-text search over long documents."""
    lead = F.regexp_replace(c, J_LEAD, "")
    return F.reverse(F.regexp_replace(F.reverse(lead), J_LEAD, ""))


def clean_text_after_nfkd(c: Column) -> Column:
    """C1 minus NFKD: drop C0 controls but tab/newline, collapse, trim."""
    no_ctrl = F.regexp_replace(c, "[\\x00-\\x08\\x0B-\\x1F]", "")
    # after collapsing, every whitespace run is one space: trim spaces only
    return F.coalesce(F.trim(collapse_ws(no_ctrl)), F.lit(""))


def clean_text(c: Column) -> Column:
    """NFKD, drop controls, every whitespace run to one space, trim."""
    return F.when(c.isNull() | (c == ""), F.lit("")) \
        .otherwise(clean_text_after_nfkd(nfkd(c)))


def fold_ascii_of_clean(cleaned: Column) -> Column:
    """C4 tail: applied to C1 output; non-ASCII runs vanish, then trim."""
    return strip_ws(F.regexp_replace(strip_ws(cleaned), "[^\\x00-\\x7F]+", ""))


def fold_ascii(c: Column) -> Column:
    """C4: C1 then drop non-ASCII (accents fold to their base letter)."""
    return fold_ascii_of_clean(clean_text(c))


def clean_snippet(c: Column) -> Column:
    """Strip tags, collapse whitespace, decode five entities in order."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    t = F.trim(collapse_ws(t))
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def reading_minutes(n_words: Column, empty_zero: Column | None = None) -> Column:
    """max(1, round-half-even(words / 200)); 0 where ``empty_zero``."""
    m = F.greatest(F.lit(1), F.bround(n_words / F.lit(200.0), 0).cast("int"))
    if empty_zero is not None:
        m = F.when(empty_zero, F.lit(0)).otherwise(m)
    return m


def detect_language(c: Column, mode: str = "page") -> Column:
    """Word-list language guess ('spanish' / 'english' / 'unknown')."""
    t = F.coalesce(c, F.lit(""))
    if mode == "page":
        min_len, n_first, es, en, floor = 50, 200, PAGE_SPANISH_WORDS, PAGE_ENGLISH_WORDS, 5
    else:
        min_len, n_first, es, en, floor = 20, 100, TEXT_SPANISH_WORDS, TEXT_ENGLISH_WORDS, None
    # exactly the first n words: split stops after n + 1 cuts (a leading
    # empty piece and the unsplit remainder are never among them)
    pieces = F.filter(F.split(t, J_WS_RUN, n_first + 2), lambda w: w != "")
    first = F.transform(F.slice(pieces, 1, n_first), lambda w: F.lower(w))
    es_arr, en_arr = lit_array(es), lit_array(en)
    n_es = F.size(F.filter(first, lambda w: F.array_contains(es_arr, w)))
    n_en = F.size(F.filter(first, lambda w: F.array_contains(en_arr, w)))
    if floor is None:
        guess = F.when(n_es > n_en, "spanish").when(n_en > n_es, "english").otherwise("unknown")
    else:
        guess = (F.when((n_es > n_en) & (n_es > floor), "spanish")
                 .when((n_en > n_es) & (n_en > floor), "english").otherwise("unknown"))
    return F.when(F.length(t) < min_len, F.lit("unknown")).otherwise(guess)


def count_contained(lower_text: Column, phrases) -> Column:
    """Number of distinct phrases that occur as a substring (each once)."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.when(lower_text.contains(p), 1).otherwise(0)
    return total


def quality_score(c: Column) -> Column:
    """Length, sentence, readability and phrase-uniqueness blend, 0..1."""
    def parts(t):
        low = F.lower(t)
        return F.struct(
            word_count(t).cast("double").alias("w"),
            (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) + 1)
            .cast("double").alias("s"),
            let(low, lambda lw: F.struct(
                count_contained(lw, QUALITY_PHRASES).cast("double").alias("q"),
                count_contained(lw, SPAM_PHRASES).cast("double").alias("m"))).alias("qm"),
            (t == "").alias("empty"))

    def combine(v):
        w, s, q, m = v["w"], v["s"], v["qm"]["q"], v["qm"]["m"]
        length_score = F.when(w < 50, w / 50.0).when(w > 10000, 10000.0 / w).otherwise(1.0)
        sentence_score = F.least(w / s / 20.0, F.lit(1.0))
        unique = F.greatest(F.lit(0.0), (q - m * 2.0) / F.greatest(q + m, F.lit(1.0)))
        readable = F.least(s / F.greatest(w / 100.0, F.lit(1.0)), F.lit(1.0))
        total = length_score * 0.2 + sentence_score * 0.3 + readable * 0.2 + unique * 0.3
        score = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
        return F.when(v["empty"], F.lit(0.0)).otherwise(score)

    return let(let(F.coalesce(c, F.lit("")), parts), combine)


def is_valid_content(c: Column) -> Column:
    """Long enough after trim and free of the invalid patterns."""
    t = F.coalesce(c, F.lit(""))

    def any_hit(low):
        hit = F.lit(False)
        for p in INVALID_PATTERNS:  # all plain literals: substring search
            hit = hit | low.contains(p)
        return hit

    # lower() bound once (filters get no common-subexpression elimination)
    return (F.length(strip_ws(t)) >= 10) & ~let(F.lower(t), any_hit)


# The same four patterns spelled with explicit Unicode classes, so Java and
# RE2 agree with Python's Unicode \d, \w and \s.
PORTABLE_LOW_QUALITY_LINE_PATTERNS = (
    LOW_QUALITY_LINE_PATTERNS[0],
    LOW_QUALITY_LINE_PATTERNS[1],
    "^\\p{Nd}+$",
    "^[^\\p{L}\\p{N}_" + WS_CLASS[1:-1] + "]+$",
)


def low_quality_line(line: Column) -> Column:
    """C9 predicate on one line."""
    pred = F.lit(False)
    for p in PORTABLE_LOW_QUALITY_LINE_PATTERNS:
        pred = pred | line.rlike(p)
    return pred


def keep_where(df, name: str, value: Column, pred):
    """Add column ``name`` = ``value`` and keep rows where ``pred(value)``,
    evaluating ``value`` once.

    A plain ``withColumn`` + ``where`` lets filter pushdown copy ``value``
    into the filter, so an expensive expression runs twice. Filtering a
    one-element array and exploding it is a generator, which no filter is
    pushed through.
    """
    kept = F.filter(F.array(value), pred)
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(kept).alias(name))
