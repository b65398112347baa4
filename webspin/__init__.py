"""webspin: web-research data jobs on Spark (DataFrame in, DataFrame out).

``INVENTORY`` maps every inventory id of SURVEY section 2 to the function
that implements it; ``__spark_entry__.queries()`` has one runnable query per
id over the driver tables.
"""

from __future__ import annotations

INVENTORY = {
    # sources and sinks
    "A1": "webspin.sources.tables.load",
    "A2": "webspin.sources.tables.fetch_outcomes",
    "A3": "webspin.sources.payloads.parse_google_payloads",
    "A4": "webspin.sources.payloads.parse_searx_payloads",
    "A5": "webspin.sources.payloads.parse_bing_payloads",
    "A6": "webspin.sources.payloads.parse_instant_answers",
    "A7": "webspin.operators.html.parse_serp_html",
    "A8": "webspin.sources.payloads.parse_requests",
    "A9": "webspin.operators.search.format_results",
    "A10": "webspin.sources.tables.write_corpus",
    # URLs
    "U1": "webspin.operators.urls.canonicalize_urls",
    "U2": "webspin.operators.urls.strip_tracking_params",
    "U3": "webspin.operators.urls.url_parts",
    "U4": "webspin.operators.urls.host_of",
    "U5": "webspin.operators.urls.valid_urls",
    "U6": "webspin.operators.urls.unwrap_redirects",
    "U7": "webspin.operators.urls.resolve_links",
    "U8": "webspin.operators.urls.dedupe_urls",
    # text
    "C1": "webspin.operators.text.clean_text",
    "C2": "webspin.operators.text.clean_snippets",
    "C3": "webspin.operators.html.html_to_text",
    "C4": "webspin.operators.text.fold_ascii",
    "C5": "webspin.operators.text.exact_duplicates",
    "C6": "webspin.operators.text.reading_stats",
    "C7": "webspin.operators.text.detect_language",
    "C8": "webspin.operators.text.language_mix",
    "C9": "webspin.operators.text.drop_low_quality_lines",
    "C10": "webspin.operators.text.bound_sentences",
    "C11": "webspin.operators.text.mask_urls_emails",
    "C12": "webspin.operators.text.truncate_fields",
    # HTML extraction
    "D0": "webspin.operators.html.pruned_pages",
    "D1": "webspin.operators.html.extract_pages",
    "D2": "webspin.operators.quality.page_types",
    "D3": "webspin.operators.html.title_value",
    "D4": "webspin.operators.html.main_value",
    "D5": "webspin.operators.html.score_blocks",
    "D6": "webspin.operators.html.page_fields",
    "D7": "webspin.operators.html.page_fields",
    "D8": "webspin.operators.html.page_fields",
    "D9": "webspin.operators.html.keyword_values",
    "D10": "webspin.operators.urls.raw_links",
    "D11": "webspin.operators.html.targets_of",
    "D12": "webspin.operators.html.rules_for",
    "D13": "webspin.operators.html.main_block",
    # quality
    "E1": "webspin.operators.quality.quality_scores",
    "E2": "webspin.operators.quality.valid_content",
    "E3": "webspin.operators.quality.validate_extraction",
    "E4": "webspin.operators.quality.length_window",
    "E5": "webspin.operators.quality.quality_report",
    # search results
    "F1": "webspin.operators.search.drop_blocked",
    "F2": "webspin.operators.search.keep_preferred",
    "F3": "webspin.operators.search.domain_priority",
    "F4": "webspin.operators.search.filter_domains",
    "F5": "webspin.operators.search.relevance",
    "F6": "webspin.operators.search.top_results",
    "F7": "webspin.operators.search.engine_fallback",
    "F9": "webspin.operators.search.enrich_results",
    "F10": "webspin.operators.search.infer_content_type",
    "F11": "webspin.operators.search.expand_queries",
    "F12": "webspin.operators.search.valid_results",
    "F13": "webspin.operators.search.normalize_results",
    "F14": "webspin.operators.search.engine_health",
    "F15": "webspin.operators.search.available_engines",
    "F16": "webspin.operators.search.tool_stats",
    # robots
    "G1": "webspin.operators.robots.robots_rules",
    "G2": "webspin.operators.robots.path_matches",
    "G3": "webspin.operators.robots.robots_allowed",
    "G4": "webspin.operators.robots.robots_refresh_points",
    # cache
    "H1": "webspin.operators.cache.cache_keys",
    "H2": "webspin.operators.cache.cache_hits",
    "H3": "webspin.operators.cache.cache_evict",
    "H4": "webspin.operators.cache.cache_hit_rate",
    # rate limits and pacing
    "I1": "webspin.operators.limits.applicable_limits",
    "I2": "webspin.operators.limits.window_counts",
    "I3": "webspin.operators.limits.gap_violations",
    "I4": "webspin.operators.limits.replay_limits",
    "I5": "webspin.operators.limits.backoff",
    "I6": "webspin.operators.limits.limit_stats",
    "I7": "webspin.operators.limits.limit_status",
    "I8": "webspin.operators.limits.expire_idle",
    "I9": "webspin.operators.limits.pace_requests",
    "I10": "webspin.operators.limits.tool_window_waits",
    "I11": "webspin.operators.limits.retry_schedule",
    # conversations and step logs
    "J1": "webspin.operators.sessions.chat_history",
    "J2": "webspin.operators.sessions.history_at_turn",
    "J3": "webspin.operators.sessions.memory_window",
    "J4": "webspin.operators.sessions.session_status",
    "J5": "webspin.operators.sessions.session_list",
    "J6": "webspin.operators.sessions.step_metrics",
    "J7": "webspin.operators.sessions.keep_last_steps",
    "J8": "webspin.operators.sessions.number_steps",
    "J9": "webspin.operators.sessions.reasoning_lines",
    "J10": "webspin.operators.sessions.answer_confidence",
    "J11": "webspin.operators.sessions.tool_confidence",
    "J12": "webspin.operators.sessions.result_confidence",
    "J13": "webspin.operators.sessions.execution_stats",
    "J15": "webspin.operators.sessions.render_prompts",
    "J16": "webspin.operators.sessions.workflow_continuity",
    "J17": "webspin.operators.sessions.usage_share",
    "J18": "webspin.operators.sessions.weighted_assign",
    # corpus jobs
    "X10": "webspin.plans.corpus.crawl_frontier",
    "X11": "webspin.plans.corpus.link_graph",
    "X12": "webspin.plans.corpus.curate_corpus",
    # streaming forms
    "H2-stream": "webspin.streaming.streams.cache_hits_stream",
    "I4-stream": "webspin.streaming.streams.replay_limits_stream",
    "I2-stream": "webspin.streaming.stateful.window_counts_stream",
    "I8-stream": "webspin.streaming.stateful.expire_idle_stream",
    "J1-stream": "webspin.streaming.stateful.chat_history_stream",
    "A10-stream": "webspin.sources.tables.write_stream_corpus",
    "A1-dump": "webspin.sources.dump.read_dump",
    "G5": "webspin.plans.asof.as_of",
    "I12": "webspin.plans.asof.as_of",
    "F16-stream": "webspin.streaming.streams.daily_tool_stats_stream",
    "J6-stream": "webspin.streaming.streams.session_metrics_stream",
    "U8-stream": "webspin.streaming.streams.dedupe_urls_stream",
}


def resolve(inventory_id: str):
    """The function implementing an inventory id."""
    import importlib

    mod, _, name = INVENTORY[inventory_id].rpartition(".")
    return getattr(importlib.import_module(mod), name)
