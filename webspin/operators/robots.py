"""Robots rules, path matching, allow decisions, refresh points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspin.operators.cache import ttl_replay

DEFAULT_AGENT = "webspinbot"


def robots_rules(robots: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """G1: (domain, agent, kind, prefix) rows. A rule belongs to the latest
    user-agent line (agent lower-cased); blank and '#' lines are skipped;
    empty values are dropped. The window is per robots file (small)."""
    lines = robots.select(F.col(domain).alias("domain"),
                          F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                          .alias("pos", "raw"))
    ln = F.trim(F.col("raw"))
    low = F.lower(ln)
    value = F.trim(F.expr("substring(trim(raw), instr(trim(raw), ':') + 1)"))
    x = lines.where((ln != "") & ~ln.startswith("#")).select(
        "domain", "pos",
        F.when(low.startswith("user-agent:"), F.lower(value)).alias("_agent"),
        F.when(low.startswith("disallow:"), F.lit("disallow"))
        .when(low.startswith("allow:"), F.lit("allow")).alias("kind"),
        value.alias("prefix"))
    w = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("agent", F.last("_agent", ignorenulls=True).over(w))
    return x.where(F.col("kind").isNotNull() & F.col("agent").isNotNull() & (F.col("prefix") != "")) \
        .select("domain", "agent", "kind", "prefix", "pos")


def path_matches(path: Column, pattern: Column) -> Column:
    """G2: '/' matches all; a trailing '*' is a prefix; else a prefix."""
    return (pattern == "/") | F.when(
        pattern.endswith("*"),
        F.startswith(path, F.substring(pattern, F.lit(1), F.length(pattern) - 1))
    ).otherwise(F.startswith(path, pattern))


def robots_allowed(urls: DataFrame, rules: DataFrame, user_agent: str = DEFAULT_AGENT,
                   id_col: str = "page_id") -> DataFrame:
    """Allowed iff no rule, or any allow match, or no disallow match.

    ``urls`` has (id, domain, path, ...). The rules become one array row per
    domain (as long as its robots file), so that one left join and an
    ``exists`` decide: no fan-out per rule, nothing to regroup. A hot domain is
    a skewed key on the streamed side, which AQE's skew join splits.
    """
    ua = user_agent.lower()
    r = rules.where(F.col("agent").isin(ua, "*")).groupBy(F.col("domain").alias("_rd")).agg(
        F.collect_list(F.struct("kind", "prefix")).alias("_rules"))
    m = urls.join(r, urls["domain"] == r["_rd"], "left")
    none = F.coalesce("_rules", F.array().cast("array<struct<kind:string,prefix:string>>"))

    def hit(kind):
        return F.exists(none, lambda x: (x["kind"] == kind) & path_matches(F.col("path"), x["prefix"]))

    return m.withColumn("allowed", F.coalesce(hit("allow"), F.lit(False)) | ~F.coalesce(hit("disallow"), F.lit(False))).drop("_rd", "_rules")


def robots_refresh_points(log: DataFrame, ttl_s: float = 3600.0,
                          key_cols: tuple[str, str] = ("domain", "agent")) -> DataFrame:
    """Per (domain, agent), the requests that (re)fetch robots.txt: the
    cached file is reused while its age is < ttl, else fetched again."""
    keyed = log.withColumn("_rkey", F.concat_ws(":", *[F.col(c) for c in key_cols]))
    rep = ttl_replay(keyed, "_rkey", ttl_s, success=None)
    return rep.withColumn("refetch", ~F.col("hit"))
