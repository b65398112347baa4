"""Registered queries: conversation and step-log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspin.operators import sessions as J
from webspin.sources.derived import steps
from webspin.sources.tables import load

EVENT_POOL = ["click", "error", "purchase", "signup", "view"]


def _conv(spark, sf):
    return load(spark, sf, "conversations")


def q_j1(spark, sf):
    return J.chat_history(_conv(spark, sf))


def q_j2(spark, sf):
    return J.history_at_turn(_conv(spark, sf))


def q_j3(spark, sf):
    return J.memory_window(_conv(spark, sf))


def q_j4(spark, sf):
    return J.session_status(_conv(spark, sf))


def q_j5(spark, sf):
    return J.session_list(_conv(spark, sf))


def q_j6(spark, sf):
    return J.step_metrics(steps(spark, sf))


def q_j7(spark, sf):
    return J.keep_last_steps(steps(spark, sf)).select("session_id", "event_id")


def q_j8(spark, sf):
    return J.number_steps(steps(spark, sf)).select("session_id", "event_id", "step")


def q_j9_reasoning(spark, sf):
    return J.reasoning_lines(steps(spark, sf))


def q_j9_sources(spark, sf):
    # the step log's tools are event types; 'view' plays the search tool here
    return J.sources_used(steps(spark, sf), search_tool="view")


def q_j10(spark, sf):
    c = _conv(spark, sf).where(F.col("role") == "assistant")
    return J.answer_confidence(c).select("conv_id", "turn", "confidence")


def q_j11(spark, sf):
    return J.tool_confidence(steps(spark, sf))


def q_j12(spark, sf):
    return J.result_confidence(_conv(spark, sf)).select("conv_id", "turn", "confidence")


def q_j13(spark, sf):
    return J.execution_stats(steps(spark, sf))


def q_j15(spark, sf):
    return J.render_prompts(_conv(spark, sf))


def q_j15_styles(spark, sf):
    # every style once per turn, from one history
    return J.render_styles(_conv(spark, sf), [style for style, _ in J.PROMPT_TEMPLATES]) \
        .select("style", "conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


def q_j16(spark, sf):
    return J.workflow_continuity(_conv(spark, sf))


def q_j17(spark, sf):
    return J.usage_share(load(spark, sf, "events"), "event_type", EVENT_POOL)


def q_j18(spark, sf):
    ev = load(spark, sf, "events").select("event_id")
    out = J.weighted_assign(ev, "event_id", [("chrome", 0.6), ("firefox", 0.25), ("safari", 0.15)])
    return out.groupBy("assigned").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "J1_chat_history": q_j1,
    "J2_history_at_turn": q_j2,
    "J3_memory_window": q_j3,
    "J4_session_status": q_j4,
    "J5_session_list": q_j5,
    "J6_step_metrics": q_j6,
    "J7_keep_last_steps": q_j7,
    "J8_number_steps": q_j8,
    "J9_reasoning_lines": q_j9_reasoning,
    "J9_sources_used": q_j9_sources,
    "J10_answer_confidence": q_j10,
    "J11_tool_confidence": q_j11,
    "J12_result_confidence": q_j12,
    "J13_execution_stats": q_j13,
    "J15_render_prompts": q_j15,
    "J15_prompt_styles": q_j15_styles,
    "J16_workflow_continuity": q_j16,
    "J17_usage_share": q_j17,
    "J18_weighted_assign": q_j18,
}
