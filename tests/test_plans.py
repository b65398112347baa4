"""Plan-shape tests: the scale properties we rely on stay in the plans."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as E
from tests.conftest import SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_plan_shapes(spark):
    q = E.queries()
    flagship = plan(q["flagship_best_pages"](spark, SMALL))
    assert "WindowGroupLimit" in flagship                    # top-k per host, map side
    u1 = plan(q["U1_canonicalize_urls"](spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in u1   # html never read
    j8 = plan(q["J8_number_steps"](spark, SMALL))
    assert "_kb" in j8 and "InPandas" not in j8 and "rangepartitioning" not in j8   # native, by value buckets
    for name in ("J2_history_at_turn", "I2_window_counts", "I3_gap_violations", "I5_backoff", "I9_pace_requests", "I10_tool_window_waits"):
        assert "InPandas" not in plan(q[name](spark, SMALL)), name
    for name in ("F1_drop_blocked", "F2_keep_preferred", "F3_domain_priority", "F4_filter_domains", "F6_top_results", "F10_infer_content_type"):
        assert "html" not in plan(q[name](spark, SMALL)), name     # the page text is never read
    assert plan(q["G3_robots_allowed"](spark, SMALL)).count("Generate") <= 2    # no fan-out per rule
    e5 = plan(q["E5_quality_report"](spark, SMALL))
    assert "partial_" in e5                                   # map-side partial aggregation
    for name in ("F1_drop_blocked", "J3_memory_window", "X10_crawl_frontier"):
        p = plan(q[name](spark, SMALL))
        assert "CartesianProduct" not in p
        if name != "F1_drop_blocked":                         # F1: bounded name list only
            assert "BroadcastNestedLoopJoin" not in p, name


def test_prompt_styles_share_one_history(spark):
    def windows(name):
        return E.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows("J15_prompt_styles") == windows("J15_render_prompts") > 0
