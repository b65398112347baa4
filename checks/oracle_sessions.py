"""DuckDB oracle SQL for the conversation and step-log queries."""

from __future__ import annotations

from checks import sqlparts as S
from webspin import dims
from webspin.operators import sessions as J
from webspin.plans.catalog_sessions import EVENT_POOL

LINE = (f"(CASE WHEN role = 'user' THEN {S.q(J.USER_LABEL)} ELSE {S.q(J.ASSISTANT_LABEL)} END)"
        f" || ': ' || coalesce(text, '')")

J1 = f"""
WITH r AS (SELECT conv_id, turn, {LINE} AS line,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM r WHERE rn <= 6 GROUP BY conv_id
"""

HIST = f"""h AS (
  SELECT conv_id, turn, role, text,
         array_to_string(list({LINE}) OVER (PARTITION BY conv_id ORDER BY turn
                          ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), chr(10)) AS history
  FROM conversations)"""

J2 = f"WITH {HIST} SELECT conv_id, turn, history FROM h WHERE role = 'user'"

_PROF = " UNION ALL ".join(f"SELECT {S.q(l)} AS level, {k} AS k" for l, k in dims.MEMORY_PROFILES)

J3 = f"""
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
           FROM conversations),
p AS ({_PROF})
SELECT level, conv_id, turn, role FROM r JOIN p ON r.rn <= p.k
"""

J4 = """
SELECT conv_id, count(*) AS message_count,
       sum(len(regexp_extract_all(coalesce(text, ''), 'https?://'))) AS sources_found,
       max(turn) AS last_turn, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id
"""

J5 = """
SELECT conv_id, count(*) AS message_count, count(DISTINCT conv_id) AS n_sessions
FROM conversations GROUP BY ROLLUP (conv_id)
"""

J6 = """
WITH g AS (
  SELECT user_id AS session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS d,
         count(*) FILTER (WHERE event_type <> 'error') AS total_steps, count(*) AS actions_count
  FROM events GROUP BY user_id)
SELECT session_id, d AS duration_s, total_steps, actions_count,
       d / greatest(total_steps, 1) AS avg_step_time,
       total_steps / greatest(actions_count, 1)::DOUBLE AS success_rate
FROM g
"""

J7 = """
SELECT session_id, event_id FROM (
  SELECT user_id AS session_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 50
"""

J8 = """
SELECT user_id AS session_id, event_id,
       CAST(coalesce(sum(CAST(event_type <> 'error' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step
FROM events
"""

J9_REASONING = """
SELECT session_id, event_id, step_no,
       format('Step {}: Used {} with input: {}', step_no, event_type, left(props, 500)) AS line
FROM (SELECT user_id AS session_id, event_id, event_type, props,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no FROM events)
"""

J9_SOURCES = """
SELECT user_id AS session_id, event_id, event_type AS tool, left(props, 500) AS input
FROM events WHERE event_type = 'view'
"""


def _conf_words(low: str) -> str:
    return " OR ".join(f"contains({low}, {S.q(w)})" for w in J.CONFIDENCE_WORDS)


J10 = f"""
SELECT conv_id, turn,
       round(least((CASE WHEN length(t) > 200 THEN 0.8::DOUBLE WHEN length(t) > 100 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END)
                   + (CASE WHEN {_conf_words('lower(t)')} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE), 6) AS confidence
FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant')
"""

J11 = """
SELECT user_id AS session_id, count(*) AS tools_used,
       round(least(0.6::DOUBLE + least(count(*) * 0.1::DOUBLE, 0.3::DOUBLE), 0.95::DOUBLE), 6) AS confidence
FROM events GROUP BY user_id
"""

J12 = """
SELECT conv_id, turn,
       CASE WHEN text IS NULL THEN 0.0::DOUBLE WHEN length(text) > 50 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM conversations
"""

J13 = """
SELECT event_type AS tool, count(*) AS execution_count, max(ts) AS last_execution,
       count(*) FILTER (WHERE value > 60.0) AS n_over_limit
FROM events GROUP BY event_type
"""

_TMPL = dict(J.PROMPT_TEMPLATES)["general"]

J15 = f"""
WITH {HIST}
SELECT conv_id, turn,
       replace(replace(replace(replace({S.q(_TMPL)}, '{{topic}}', 'session ' || CAST(conv_id AS VARCHAR)),
               '{{objectives}}', {S.q(J.DEFAULT_OBJECTIVES)}), '{{history}}', history), '{{input}}', text) AS prompt
FROM h WHERE role = 'user'
"""

_STYLES = " UNION ALL ".join(f"SELECT {S.q(k)} AS style, {S.q(v)} AS tmpl" for k, v in J.PROMPT_TEMPLATES)

J15_STYLES = f"""
WITH {HIST}, st AS ({_STYLES})
SELECT style, conv_id, turn,
       md5(replace(replace(replace(replace(tmpl, '{{topic}}', 'session ' || CAST(conv_id AS VARCHAR)),
               '{{objectives}}', {S.q(J.DEFAULT_OBJECTIVES)}), '{{history}}', history), '{{input}}', text)) AS prompt_md5
FROM h CROSS JOIN st WHERE role = 'user'
"""

J16 = """
SELECT conv_id, n_steps, all_ok, n_distinct,
       (n_steps < 2 OR (all_ok AND n_distinct / n_steps >= 0.8)) AS continuity_ok
FROM (SELECT conv_id, count(*) AS n_steps, bool_and(trim(coalesce(text, '')) <> '') AS all_ok,
             count(DISTINCT text) AS n_distinct
      FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
"""

_POOL = " UNION ALL ".join(f"SELECT {S.q(c)} AS category, {i} AS pool_pos" for i, c in enumerate(EVENT_POOL))

J17 = f"""
WITH p AS ({_POOL}),
u AS (SELECT event_type AS category, count(*) AS uses FROM events GROUP BY event_type),
j AS (SELECT p.category, CAST(p.pool_pos AS INTEGER) AS pool_pos, coalesce(u.uses, 0) AS uses
      FROM p LEFT JOIN u USING (category)),
t AS (SELECT sum(uses) AS total FROM j),
mo AS (SELECT category FROM j ORDER BY uses DESC, pool_pos LIMIT 1),
le AS (SELECT category FROM j ORDER BY uses, pool_pos LIMIT 1)
SELECT j.category, j.pool_pos, j.uses,
       round(CASE WHEN t.total > 0 THEN j.uses / t.total * 100.0 ELSE 0.0 END, 6) AS percentage,
       j.category = (SELECT category FROM mo) AS is_most_used,
       j.category = (SELECT category FROM le) AS is_least_used
FROM j, t
"""

def _j18():
    weights = [("chrome", 0.6), ("firefox", 0.25), ("safari", 0.15)]
    total = float(sum(w for _, w in weights))
    x = "CAST(CAST('0x' || substr(md5('42' || ':' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)"
    whens, cum = [], 0.0
    for c, w in weights[:-1]:
        cum += w
        whens.append(f"WHEN {x} * {total!r}::DOUBLE < {cum * 4294967296.0!r}::DOUBLE THEN {S.q(c)}")
    pick = f"CASE {' '.join(whens)} ELSE {S.q(weights[-1][0])} END"
    return f"SELECT {pick} AS assigned, count(*) AS n FROM events GROUP BY ALL"


J18 = _j18()

ORACLE = {
    "J18_weighted_assign": J18,
    "J1_chat_history": J1,
    "J2_history_at_turn": J2,
    "J3_memory_window": J3,
    "J4_session_status": J4,
    "J5_session_list": J5,
    "J6_step_metrics": J6,
    "J7_keep_last_steps": J7,
    "J8_number_steps": J8,
    "J9_reasoning_lines": J9_REASONING,
    "J9_sources_used": J9_SOURCES,
    "J10_answer_confidence": J10,
    "J11_tool_confidence": J11,
    "J12_result_confidence": J12,
    "J13_execution_stats": J13,
    "J15_render_prompts": J15,
    "J15_prompt_styles": J15_STYLES,
    "J16_workflow_continuity": J16,
    "J17_usage_share": J17,
}
