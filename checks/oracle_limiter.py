"""DuckDB recursive-CTE oracle for the limiter replay (I4) and its stats.

State per identifier: a list of five per-type records (shared keys), in the
order below; each request is one recursion step (SURVEY 2.K)."""

from __future__ import annotations

from checks import sqlparts as S
from checks.oracle_logs import RL
from webspin import dims
from webspin.plans.catalog_logs import WINDOW_LIMIT, WINDOW_S

TYPES = ["requests_per_minute", "requests_per_hour", "requests_per_day", "concurrent_requests",
         "delay_between_requests"]
WIN = {1: 60, 2: 3600, 3: 86400}
SCOPE = {"global": 0, "domain": 1, "engine": 2}

_LIMS = list(dims.RATE_LIMITS) + [("global", "*", "requests_per_hour", float(WINDOW_LIMIT), WINDOW_S)]
LIM = "lim AS (" + " UNION ALL ".join(
    f"SELECT {S.q(sc)} AS scope, {S.q(k)} AS key, {TYPES.index(t) + 1} AS t, {l}::DOUBLE AS lim, "
    f"{w}::DOUBLE AS win, {SCOPE[sc]} AS so, {i} AS pos" for i, (sc, k, t, l, w) in enumerate(_LIMS)) + ")"

_WEXPR = "CASE a.t WHEN 1 THEN 60.0 WHEN 2 THEN 3600.0 WHEN 3 THEN 86400.0 ELSE 0.0 END"

INIT = ("[" + ", ".join(["{'ts': []::DOUBLE[], 'last': 0.0::DOUBLE, 'viol': 0, 'blocked': NULL::DOUBLE}"] * 5)
        + "]")

FLAGS = (f"list_transform(app, lambda a: {{'blocked': coalesce(s[a.t].blocked IS NOT NULL AND now < s[a.t].blocked, false), "
         f"'fail': CASE WHEN a.t <= 3 THEN len(list_filter(s[a.t].ts, lambda x: x > now - {_WEXPR})) >= a.lim "
         f"WHEN a.t = 5 THEN NOT (s[a.t].last = 0 OR now - s[a.t].last >= a.lim) ELSE false END}})")

STEP = f"""
SELECT identifier, rn, event_id, domain, allowed, counted,
       CASE WHEN counted THEN list_extract({S.arr(TYPES)}, app[j].t) END AS vtype,
       CASE WHEN allowed THEN list_transform(range(1, 6), lambda k:
              CASE WHEN list_contains(list_transform(app, lambda a: a.t), k)
                   THEN {{'ts': list_concat(s[k].ts, list_transform(list_filter(app, lambda a: a.t = k AND a.t <= 3), lambda a: now)),
                         'last': now, 'viol': 0, 'blocked': NULL::DOUBLE}}
                   ELSE s[k] END)
            WHEN counted THEN list_transform(range(1, 6), lambda k:
              CASE WHEN k = app[j].t
                   THEN {{'ts': s[k].ts, 'last': s[k].last, 'viol': s[k].viol + 1,
                         'blocked': now + least((CASE WHEN app[j].win > 0 THEN app[j].win ELSE {dims.DEFAULT_DELAY}::DOUBLE END)
                                                * pow({dims.BACKOFF_FACTOR}::DOUBLE, s[k].viol), {float(dims.MAX_DELAY)}::DOUBLE)}}
                   ELSE s[k] END)
            ELSE s END AS s
FROM (
  SELECT *, j = 0 AS allowed, j > 0 AND NOT flags[j].blocked AS counted FROM (
    SELECT *, coalesce(list_position(list_transform(flags, lambda f: f.blocked OR f.fail), true), 0) AS j FROM (
      SELECT z.*, {FLAGS} AS flags FROM (
        SELECT o.identifier, o.rn, o.event_id, o.domain, o.now, o.app, rec.s
        FROM rec JOIN o ON o.identifier = rec.identifier AND o.rn = rec.rn + 1) z)))
"""

I4 = f"""
WITH RECURSIVE {RL}, {LIM},
app AS (SELECT rl.event_id, list({{'t': lim.t, 'lim': lim.lim, 'win': lim.win}} ORDER BY lim.so, lim.pos) AS app
        FROM rl JOIN lim ON lim.scope = 'global' OR (lim.scope = 'domain' AND lim.key = rl.domain)
                         OR (lim.scope = 'engine' AND lim.key = rl.engine)
        GROUP BY rl.event_id),
o AS (SELECT rl.identifier, rl.event_id, rl.domain, epoch_us(rl.ts) / 1000000.0::DOUBLE AS now, app.app,
             row_number() OVER (PARTITION BY rl.identifier ORDER BY rl.ts, rl.event_id) AS rn
      FROM rl JOIN app USING (event_id)),
rec AS (
  SELECT identifier, 0 AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS domain, NULL::BOOLEAN AS allowed,
         NULL::BOOLEAN AS counted, NULL::VARCHAR AS vtype, {INIT} AS s
  FROM (SELECT DISTINCT identifier FROM o)
  UNION ALL
  {STEP}
)
"""

I4_SQL = I4 + """SELECT event_id, identifier, allowed, counted AS counted_block, vtype AS violating_type
FROM rec WHERE rn > 0"""

I6_SQL = I4 + """SELECT domain, count(*) FILTER (WHERE allowed) AS allowed,
       count(*) FILTER (WHERE NOT allowed) AS blocked, count(*) FILTER (WHERE counted) AS violations
FROM rec WHERE rn > 0 GROUP BY domain"""

ORACLE = {"I4_replay_limits": I4_SQL, "I6_limit_stats": I6_SQL}
