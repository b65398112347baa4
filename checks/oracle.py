"""All oracle SQL strings, keyed like the query registry."""

from __future__ import annotations

import importlib

MODULES = (
    "checks.oracle_urls",
    "checks.oracle_text",
    "checks.oracle_sessions",
    "checks.oracle_logs",
    "checks.oracle_search",
    "checks.oracle_html",
    "checks.oracle_payloads",
    "checks.oracle_limiter",
)


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(name).ORACLE)
    return out
