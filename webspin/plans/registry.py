"""One registry of named queries, one entry per inventory id."""

from __future__ import annotations

import importlib

MODULES = (
    "webspin.plans.catalog_urls",
    "webspin.plans.catalog_text",
    "webspin.plans.catalog_sessions",
    "webspin.plans.catalog_logs",
    "webspin.plans.catalog_search",
    "webspin.plans.catalog_html",
)


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(name).QUERIES)
    return out
