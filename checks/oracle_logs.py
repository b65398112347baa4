"""DuckDB oracle SQL for the closed-form log jobs (I, H1, G1, G3)."""

from __future__ import annotations

from checks import sqlparts as S
from webspin import dims
from webspin.plans.catalog_logs import WINDOW_LIMIT, WINDOW_S
from webspin.sources import derived as D

_ENGINE = "CASE event_type " + " ".join(f"WHEN {S.q(e)} THEN {S.q(g)}" for e, g in dims.EVENT_ENGINE) \
    + " ELSE 'duckduckgo' END"

RL = f"""rl AS (
  SELECT event_id, user_id AS identifier,
         list_extract({S.arr(dims.PRESET_DOMAINS)}, CAST(user_id % {len(dims.PRESET_DOMAINS)} AS INTEGER) + 1) AS domain,
         {_ENGINE} AS engine, ts FROM events)"""

LIMITS = "lim AS (" + " UNION ALL ".join(
    f"SELECT {S.q(sc)} AS scope, {S.q(k)} AS key, {S.q(t)} AS limit_type, {l}::DOUBLE AS \"limit\", "
    f"CAST({w} AS INTEGER) AS \"window\"" for sc, k, t, l, w in dims.RATE_LIMITS) + ")"

KEYS = """keys AS (
  SELECT event_id, identifier, ts, 'global' AS scope, '*' AS key FROM rl
  UNION ALL SELECT event_id, identifier, ts, 'domain', domain FROM rl
  UNION ALL SELECT event_id, identifier, ts, 'engine', engine FROM rl)"""

I1 = f"""
WITH {RL}, {LIMITS}, {KEYS}
SELECT event_id, keys.scope, keys.key, limit_type, "limit", "window"
FROM keys JOIN lim ON keys.scope = lim.scope AND keys.key = lim.key
"""

_W = f"(PARTITION BY identifier ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_S * 1_000_000 - 1} PRECEDING AND 1 PRECEDING)"

I2 = f"""
WITH {RL}
SELECT event_id, identifier, n_in_window, n_in_window >= {WINDOW_LIMIT} AS violation
FROM (SELECT event_id, identifier, count(*) OVER {_W} AS n_in_window FROM rl)
"""

I3 = f"""
WITH {RL}
SELECT event_id, identifier, gap_s, (gap_s IS NULL OR gap_s >= 60.0) AS passes
FROM (SELECT event_id, identifier,
             (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY identifier ORDER BY ts, event_id))
             / 1000000.0::DOUBLE AS gap_s FROM rl)
"""

I5 = f"""
WITH {RL},
c AS (SELECT event_id, identifier, ts, count(*) OVER {_W} >= {WINDOW_LIMIT} AS violation FROM rl)
SELECT event_id, violations_before,
       least({float(WINDOW_S)}::DOUBLE * pow(1.5::DOUBLE, violations_before), 300.0::DOUBLE) AS backoff_s
FROM (SELECT event_id, CAST(coalesce(sum(CAST(violation AS BIGINT)) OVER (PARTITION BY identifier ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS violations_before FROM c)
"""

AT = "(SELECT max(ts) FROM events)"

I7 = f"""
WITH {RL}, {LIMITS}, {KEYS},
app AS (SELECT keys.*, limit_type, "limit", "window" FROM keys JOIN lim
        ON keys.scope = lim.scope AND keys.key = lim.key WHERE "window" > 0),
ids AS (SELECT DISTINCT identifier, scope, key, limit_type, "limit", "window" FROM app),
g AS (SELECT identifier, scope, key, limit_type, count(*) AS made, min(ts) AS window_start
      FROM app WHERE epoch_us(ts) <= epoch_us({AT})
                 AND epoch_us(ts) > epoch_us({AT}) - CAST("window" AS BIGINT) * 1000000::BIGINT
      GROUP BY ALL)
SELECT identifier, scope, key, limit_type, "limit", "window", coalesce(made, 0) AS made,
       greatest("limit" - coalesce(made, 0), 0.0::DOUBLE) AS remaining,
       window_start + "window" * INTERVAL 1 SECOND AS reset_time,
       coalesce(made, 0) >= "limit" AS quota_exhausted
FROM ids LEFT JOIN g USING (identifier, scope, key, limit_type)
"""

I8 = f"""
WITH {RL}
SELECT identifier, last_ts, idle_s, idle_s > 86400.0 AS expired
FROM (SELECT identifier, max(ts) AS last_ts,
             (epoch_us({AT}) - epoch_us(max(ts))) / 1000000.0::DOUBLE AS idle_s FROM rl GROUP BY identifier)
"""

I9 = f"""
WITH {RL},
a AS (SELECT event_id, identifier, ts, epoch_us(ts) / 1000000.0::DOUBLE AS arrive_s,
             row_number() OVER (PARTITION BY identifier ORDER BY ts, event_id) - 1 AS i FROM rl),
m AS (SELECT *, max(arrive_s - i * 2.0::DOUBLE) OVER (PARTITION BY identifier ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx FROM a)
SELECT event_id, identifier, arrive_s, i * 2.0::DOUBLE + mx AS start_s, i * 2.0::DOUBLE + mx - arrive_s AS wait_s
FROM m
"""

_W60 = "(PARTITION BY identifier ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING)"

I10 = f"""
WITH {RL},
x AS (SELECT event_id, identifier, epoch_us(ts) AS t, count(*) OVER {_W60} AS n_in_window,
             min(epoch_us(ts)) OVER {_W60} AS oldest FROM rl)
SELECT event_id, identifier, n_in_window,
       CASE WHEN n_in_window >= 1 THEN greatest(60.0::DOUBLE - (t - oldest) / 1000000.0::DOUBLE, 0.0::DOUBLE)
            ELSE 0.0::DOUBLE END AS wait_s
FROM x
"""

I11 = """
SELECT event_id, CAST(a AS INTEGER) AS attempt,
       CASE WHEN a < 3 THEN 1.0::DOUBLE * pow(2.0::DOUBLE, a) ELSE 0.0::DOUBLE END AS wait_s
FROM (SELECT event_id, unnest(range(0, 4)) AS a FROM events WHERE event_type = 'error')
"""

I11_TOTALS = f"""
SELECT event_id, count(*) AS attempts, sum(wait_s) AS total_wait_s FROM ({I11}) GROUP BY event_id
"""

H1 = "SELECT event_id, md5(event_type || ':' || '10') AS cache_key FROM events"

_DOMAIN = S.two_label_domain(S.url_host(S.canonical_url("url")))

ROBOTS = f"""rb AS (
  SELECT domain, {S.q(D.ROBOTS_BASE)} || CASE WHEN length(domain) % 2 = 1 THEN {S.q(D.ROBOTS_EXTRA)} ELSE '' END AS text
  FROM (SELECT DISTINCT {_DOMAIN} AS domain FROM pages)),
ln AS (SELECT domain, unnest(string_split(text, chr(10))) AS raw,
              unnest(range(len(string_split(text, chr(10))))) AS pos FROM rb),
x AS (SELECT domain, pos,
             CASE WHEN starts_with(lower(trim(raw)), 'user-agent:') THEN lower(trim(substr(trim(raw), instr(trim(raw), ':') + 1))) END AS _agent,
             CASE WHEN starts_with(lower(trim(raw)), 'disallow:') THEN 'disallow'
                  WHEN starts_with(lower(trim(raw)), 'allow:') THEN 'allow' END AS kind,
             trim(substr(trim(raw), instr(trim(raw), ':') + 1)) AS prefix
      FROM ln WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')),
rules AS (SELECT domain, agent, kind, prefix, pos FROM (
            SELECT *, last_value(_agent IGNORE NULLS) OVER (PARTITION BY domain ORDER BY pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM x)
          WHERE kind IS NOT NULL AND agent IS NOT NULL AND prefix <> '')"""

G1 = f"WITH {ROBOTS} SELECT domain, agent, kind, prefix, pos FROM rules"

G3 = f"""
WITH {ROBOTS},
u AS (SELECT page_id, {S.two_label_domain(S.url_host('n'))} AS domain, {S.url_path('n')} AS path
      FROM (SELECT page_id, {S.canonical_url('url')} AS n FROM pages)),
r AS (SELECT * FROM rules WHERE agent IN ('webspinbot', '*')),
f AS (SELECT page_id, bool_or(kind = 'allow') AS a, bool_or(kind = 'disallow') AS d
      FROM u JOIN r ON u.domain = r.domain AND (
           r.prefix = '/' OR CASE WHEN ends_with(r.prefix, '*')
                                  THEN starts_with(u.path, left(r.prefix, length(r.prefix) - 1))
                                  ELSE starts_with(u.path, r.prefix) END)
      GROUP BY page_id)
SELECT u.page_id, u.domain, u.path, coalesce(f.a, false) OR NOT coalesce(f.d, false) AS allowed
FROM u LEFT JOIN f USING (page_id)
"""

G5 = f"""
WITH {RL},
f AS (SELECT domain, ts, max(event_id) AS rules_version FROM rl WHERE event_id % 97 = 0 GROUP BY domain, ts)
SELECT rl.event_id, rl.domain, f.rules_version, (epoch_us(rl.ts) - epoch_us(f.ts)) / 1000000.0::DOUBLE AS age_s,
       f.rules_version IS NULL OR rl.event_id % 3 <> f.rules_version % 3 AS allowed
FROM rl ASOF LEFT JOIN f ON rl.domain = f.domain AND rl.ts >= f.ts
"""

I12 = f"""
WITH {RL},
f AS (SELECT engine, ts, CAST(max(event_id) % 5 + 1 AS DOUBLE) AS setting FROM rl WHERE event_id % 211 = 0 GROUP BY engine, ts),
n AS (SELECT *, count(*) OVER (PARTITION BY identifier ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS n_in_window FROM rl)
SELECT event_id, identifier, n.engine, coalesce(setting, 3.0::DOUBLE) AS "limit", n_in_window,
       greatest(coalesce(setting, 3.0::DOUBLE) - n_in_window, 0.0::DOUBLE) AS remaining
FROM n ASOF LEFT JOIN f ON n.engine = f.engine AND n.ts >= f.ts
"""

ORACLE = {
    "G5_rules_at_request": G5,
    "I12_quota_at_request": I12,
    "I1_applicable_limits": I1,
    "I2_window_counts": I2,
    "I3_gap_violations": I3,
    "I5_backoff": I5,
    "I7_limit_status": I7,
    "I8_expire_idle": I8,
    "I9_pace_requests": I9,
    "I10_tool_window_waits": I10,
    "I11_retry_schedule": I11,
    "I11_retry_totals": I11_TOTALS,
    "H1_cache_keys": H1,
    "G1_robots_rules": G1,
    "G3_robots_allowed": G3,
}

G2 = f"""
WITH {ROBOTS},
u AS (SELECT page_id, {S.two_label_domain(S.url_host('n'))} AS domain, {S.url_path('n')} AS path
      FROM (SELECT page_id, {S.canonical_url('url')} AS n FROM pages))
SELECT page_id, agent, kind, pos,
       (prefix = '/' OR CASE WHEN ends_with(prefix, '*') THEN starts_with(path, left(prefix, length(prefix) - 1))
                             ELSE starts_with(path, prefix) END) AS matches
FROM u JOIN rules r ON u.domain = r.domain
"""

ORACLE["G2_path_matches"] = G2
