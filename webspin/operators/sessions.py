"""Conversation and step-log jobs (windows and aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspin import dims
from webspin.plans.scan import IDS, keyed_prefix

# Fixed values that must equal the reference (history labels and fallbacks, J1/J9/J15).
USER_LABEL = "Humano"
ASSISTANT_LABEL = "Asistente"
NO_HISTORY = "No hay mensajes previos."
DEFAULT_OBJECTIVES = "General research"
CONFIDENCE_WORDS = ("source", "found", "search", "according")


def _history_line(role: Column, text: Column) -> Column:
    label = F.when(role == "user", F.lit(USER_LABEL)).otherwise(F.lit(ASSISTANT_LABEL))
    return F.concat(label, F.lit(": "), F.coalesce(text, F.lit("")))


def chat_history(msgs: DataFrame, n: int = 6, key: str = "conv_id", order: str = "turn",
                 sessions: DataFrame | None = None) -> DataFrame:
    """Last n messages per conversation as the prompt history string;
    sessions (if given) without any message get the fixed sentence.

    ``row_number() <= n`` plans as a WindowGroupLimit (map-side top-n), so the
    collected list per key is bounded by n whatever the key's size.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = msgs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    agg = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), _history_line(F.col("role"), F.col("text")).alias("line"))))
        .alias("_lines"))
    out = agg.select(key, F.array_join(F.transform("_lines", lambda s: s["line"]), "\n")
                     .alias("history"))
    if sessions is not None:
        out = sessions.select(key).join(out, key, "left") \
            .withColumn("history", F.coalesce(F.col("history"), F.lit(NO_HISTORY)))
    return out


def history_at_turn(msgs: DataFrame, n: int = 6, key: str = "conv_id",
                    order: str = "turn") -> DataFrame:
    """The history a prompt sees at each user turn (the new message is
    already in it): the last n messages up to and including this one.

    Skew-safe: positions come from the bucketed running count, then each
    message goes to the block of ``block`` positions it stands in, and the last
    n - 1 of a block to the next one as well. A native row window inside
    (key, block) collects the lines.
    """
    block = 1024
    base = msgs.select(key, order, "role", "text", F.lit(1).cast("long").alias("_one"))
    pos = keyed_prefix(base, key, [order], "_one", "_pos", op="sum", inclusive=True, width=IDS)
    own = F.floor(F.col("_pos") / block)
    halo = F.when(F.col("_pos") % block > block - n, F.array(own, own + 1)).otherwise(F.array(own))
    both = pos.select(key, order, "role", "_pos", own.alias("_own"), _history_line(F.col("role"), F.col("text")).alias("_line"),
                      F.explode(halo).alias("_b"))
    w = Window.partitionBy(key, "_b").orderBy("_pos").rowsBetween(-(n - 1), 0)
    lines = both.withColumn("_ls", F.collect_list("_line").over(w))
    return lines.where((F.col("role") == "user") & (F.col("_b") == F.col("_own"))) \
        .select(key, order, F.array_join("_ls", "\n").alias("history"))


def memory_window(msgs: DataFrame, key: str = "conv_id", order: str = "turn",
                  profiles: list[tuple[str, int]] | None = None) -> DataFrame:
    """The last k messages kept per memory profile (k = 20 / 10 / 5).

    Top-kmax per conversation (WindowGroupLimit), then each kept message is
    emitted once per profile whose k covers it: a filtered array of the
    (bounded) profiles and an explode, no join.
    """
    prof = profiles or dims.MEMORY_PROFILES
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    kmax = max(k for _, k in prof)
    ranked = msgs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= kmax)
    levels = F.array(*[F.struct(F.lit(l).alias("level"), F.lit(k).alias("k")) for l, k in prof])
    keep = F.filter(levels, lambda p: F.col("_rn") <= p["k"])
    return ranked.select(F.explode(keep).alias("_p"), key, order, "role") \
        .select(F.col("_p.level").alias("level"), key, order, "role")


def session_status(msgs: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Message count, sources found (URLs cited), last activity."""
    return msgs.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("https?://"))).alias("sources_found"),
        F.max(order).alias("last_turn"),
        F.max_by("role", order).alias("last_role"))


def session_list(msgs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every session with its count, plus one total row (key null), which
    sums the per-session table."""
    each = msgs.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"))
    rows = each.select(key, "message_count", F.when(F.col(key).isNull(), 0).otherwise(1).cast("long").alias("n_sessions"))
    total = each.agg(F.lit(None).cast(msgs.schema[key].dataType).alias(key), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"),
                     F.count(key).alias("n_sessions"))
    return rows.unionByName(total)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def step_metrics(steps: DataFrame) -> DataFrame:
    """Duration, steps (tool successes), actions, average step time,
    success rate per session."""
    g = steps.groupBy("session_id").agg(
        ((_micros(F.max("ts")) - _micros(F.min("ts"))) / F.lit(1_000_000.0)).alias("duration_s"),
        F.count_if("success").alias("total_steps"),
        F.count(F.lit(1)).alias("actions_count"))
    return g.select(
        "session_id", "duration_s", "total_steps", "actions_count",
        (F.col("duration_s") / F.greatest(F.col("total_steps"), F.lit(1))).alias("avg_step_time"),
        (F.col("total_steps") / F.greatest(F.col("actions_count"), F.lit(1))).alias("success_rate"))


def keep_last_steps(steps: DataFrame, n: int = 50) -> DataFrame:
    """Last n actions per session (top-n: WindowGroupLimit)."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return steps.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def number_steps(steps: DataFrame) -> DataFrame:
    """Step counter = successes strictly before this action."""
    ok = steps.select("session_id", "event_id", "ts", F.col("success").cast("long").alias("_ok"))
    return keyed_prefix(ok, "session_id", ["ts", "event_id"], "_ok", "step",
                        op="sum", inclusive=False).drop("_ok")


def reasoning_lines(steps: DataFrame, max_input: int = 500) -> DataFrame:
    """J9: 'Step i: Used <tool> with input: <input>' per action in order."""
    one = steps.select("session_id", "event_id", "ts", "tool", "tool_input",
                       F.lit(1).cast("long").alias("_one"))
    numbered = keyed_prefix(one, "session_id", ["ts", "event_id"], "_one", "step_no",
                            op="sum", inclusive=True)
    return numbered.select(
        "session_id", "event_id", "step_no",
        F.format_string("Step %d: Used %s with input: %s", F.col("step_no"), F.col("tool"),
                        F.substring("tool_input", 1, max_input)).alias("line"))


def sources_used(steps: DataFrame, search_tool: str = "web_search") -> DataFrame:
    """Actions that used the search tool."""
    return steps.where(F.col("tool") == search_tool) \
        .select("session_id", "event_id", "tool", F.substring("tool_input", 1, 500).alias("input"))


def answer_confidence(msgs: DataFrame, text: str = "text") -> DataFrame:
    """0.8 / 0.6 / 0.4 by length, +0.1 if a source word appears, cap 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.when(F.length(t) > 200, 0.8).when(F.length(t) > 100, 0.6).otherwise(0.4)
    low = F.lower(t)
    hit = F.lit(False)
    for w in CONFIDENCE_WORDS:
        hit = hit | (F.instr(low, w) > 0)
    return msgs.withColumn("confidence", F.round(
        F.least(base + F.when(hit, 0.1).otherwise(0.0), F.lit(1.0)), 6))


def tool_confidence(steps: DataFrame) -> DataFrame:
    """min(0.6 + min(0.1 * tools, 0.3), 0.95) per session."""
    g = steps.groupBy("session_id").agg(F.count(F.lit(1)).alias("tools_used"))
    return g.withColumn("confidence", F.round(F.least(
        F.lit(0.6) + F.least(F.col("tools_used") * 0.1, F.lit(0.3)), F.lit(0.95)), 6))


def result_confidence(df: DataFrame, col: str = "text") -> DataFrame:
    """Null 0; text over 50 chars 0.7; non-empty array/map 0.8; else 0.5."""
    c = F.col(col)
    dtype = df.schema[col].dataType.typeName()
    if dtype in ("array", "map"):
        conf = F.when(c.isNull(), 0.0).when(F.size(c) > 0, 0.8).otherwise(0.5)
    else:
        conf = F.when(c.isNull(), 0.0).when(F.length(c) > 50, 0.7).otherwise(0.5)
    return df.withColumn("confidence", conf)


def execution_stats(steps: DataFrame, time_limit: float = 60.0) -> DataFrame:
    """Per tool, executions, last execution, runs over the time limit."""
    return steps.groupBy("tool").agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.max("ts").alias("last_execution"),
        F.count_if(F.col("value") > time_limit).alias("n_over_limit"))


# Our own prompt template (the reference's wording is not reproduced).
PROMPT_TEMPLATES = [
    ("general", "Research topic: {topic}\nGoals: {objectives}\nConversation so far:\n{history}\n"
                "Question: {input}"),
    ("academic", "Scholarly research on {topic}\nGoals: {objectives}\nConversation so far:\n"
                 "{history}\nQuestion: {input}"),
    ("business", "Market and company research on {topic}\nDecisions to support: {objectives}\n"
                 "Conversation so far:\n{history}\nQuestion: {input}"),
    ("technical", "Engineering research on {topic}\nRequirements: {objectives}\nConversation so far:\n"
                  "{history}\nProblem: {input}"),
]


def render_prompts(msgs: DataFrame, style: str = "general", n: int = 6,
                   topic_col: str | None = None, objectives_col: str | None = None) -> DataFrame:
    """One prompt per user turn: template + topic + objectives + history + input."""
    return render_styles(msgs, [style], n, topic_col, objectives_col).drop("style")


def render_styles(msgs: DataFrame, styles: list[str], n: int = 6,
                  topic_col: str | None = None, objectives_col: str | None = None) -> DataFrame:
    """One prompt per user turn and style. The histories are built and
    joined once, then each turn is written in every style."""
    known = dict(PROMPT_TEMPLATES)
    templates = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(known.get(s, known["general"])).alias("_tmpl")) for s in styles])
    h = history_at_turn(msgs, n)
    base = msgs.where(F.col("role") == "user").select("conv_id", "turn", "text")
    if topic_col:
        base = base.withColumn("_topic", F.col(topic_col))
    j = h.join(base, ["conv_id", "turn"]).select("*", F.inline(templates))
    topic = F.col("_topic") if topic_col else F.concat(F.lit("session "), F.col("conv_id").cast("string"))
    objectives = (F.when(F.size(F.col(objectives_col)) > 0, F.array_join(F.col(objectives_col), ", "))
                  .otherwise(F.lit(DEFAULT_OBJECTIVES)) if objectives_col else F.lit(DEFAULT_OBJECTIVES))
    p = F.col("_tmpl")
    for name, val in (("{topic}", topic), ("{objectives}", objectives),
                      ("{history}", F.col("history")), ("{input}", F.col("text"))):
        p = F.replace(p, F.lit(name), val)
    return j.select("style", "conv_id", "turn", p.alias("prompt"))


def workflow_continuity(msgs: DataFrame, min_distinct: float = 0.8) -> DataFrame:
    """Per conversation, answers all present, one session, >= 80 %
    distinct answers; fewer than 2 answers is continuous."""
    a = msgs.where(F.col("role") == "assistant")
    g = a.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.bool_and(F.trim(F.coalesce("text", F.lit(""))) != "").alias("all_ok"),
        F.countDistinct("text").alias("n_distinct"))
    ok = (F.col("n_steps") < 2) | (F.col("all_ok")
                                   & (F.col("n_distinct") / F.col("n_steps") >= min_distinct))
    return g.withColumn("continuity_ok", ok)


def usage_share(df: DataFrame, col: str, pool: list[str]) -> DataFrame:
    """Per pool category: uses, share of all uses in percent (0 if none),
    most / least used flags (ties go to the earlier pool entry).

    The pool is a bounded dimension; the aggregated table has one row per
    category, so its window over all rows is bounded by the pool size.
    """
    spark = df.sparkSession
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(pool)], "category string, pool_pos int")
    uses = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("uses"))
    j = F.broadcast(dim).join(uses, "category", "left").fillna(0, ["uses"])
    allw = Window.partitionBy(F.lit(0))
    total = F.sum("uses").over(allw)
    most = F.max_by(F.col("category"), F.struct(F.col("uses"), -F.col("pool_pos"))).over(allw)
    least = F.min_by(F.col("category"), F.struct(F.col("uses"), F.col("pool_pos"))).over(allw)
    return j.select(
        "category", "pool_pos", "uses",
        F.round(F.when(total > 0, F.col("uses") / total * 100.0).otherwise(0.0), 6).alias("percentage"),
        (F.col("category") == most).alias("is_most_used"),
        (F.col("category") == least).alias("is_least_used"))


def weighted_assign(df: DataFrame, id_col: str, weights: list[tuple[str, float]],
                    seed: int = 42, out: str = "assigned") -> DataFrame:
    """One category per row with probability proportional to its weight.

    Like ``random.choices``: a uniform u in [0, 1) per row, then the first
    category whose cumulative weight exceeds u * total. u comes from the first
    32 bits of md5('seed:id') — deterministic, per row, no shuffle.
    """
    total = float(sum(w for _, w in weights))
    x = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))),
                           1, 8), 16, 10).cast("long")
    scaled = x.cast("double") * F.lit(total)
    pick, cum = None, 0.0
    for c, w in weights[:-1]:
        cum += w
        cond = scaled < F.lit(cum * 4294967296.0)
        pick = F.when(cond, F.lit(c)) if pick is None else pick.when(cond, F.lit(c))
    last = F.lit(weights[-1][0])
    return df.withColumn(out, last if pick is None else pick.otherwise(last))
