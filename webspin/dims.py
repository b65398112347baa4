"""Fixed configuration tables as small DataFrames (bounded size by
construction, so joining them with ``broadcast`` is always safe).

Users extend any of them by ``unionByName`` with rows of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values that must equal the reference (page-type validation rules, E3):
# page type, minimum main-content length, quality threshold.
PAGE_TYPE_RULES = [
    ("article", 200, 0.6),
    ("documentation", 100, 0.5),
    ("forum_post", 50, 0.4),
    ("academic", 300, 0.7),
]

# Fixed values that must equal the reference (domain filters, F1-F3).
BLOCKED_DOMAINS = ["facebook.com", "twitter.com", "instagram.com", "tiktok.com", "reddit.com"]
PREFERRED_DOMAINS = ["wikipedia.org", "github.com", "stackoverflow.com", "medium.com",
                     "arxiv.org", "scholar.google.com"]
# Test-only names that match the synthetic hosts of the driver tables.
TEST_BLOCKED_DOMAINS = ["spam-farm.example.org", "cheap-pills.example.com"]
TEST_PREFERRED_DOMAINS = ["example.net"]

# Fixed values that must equal the reference (search engines, F14/F15):
# engine, display name, requires_api_key, enabled, rate limit per minute, timeout s.
ENGINES = [
    ("duckduckgo", "DuckDuckGo", False, True, 30, 10),
    ("google_custom", "Google Custom Search", True, False, 100, 15),
    ("bing", "Bing Search", True, False, 1000, 15),
    ("searx", "SearX", False, True, 60, 20),
]
DEFAULT_ENGINE = "duckduckgo"
FALLBACK_ENGINES = ["searx", "duckduckgo"]

# Fixed values that must equal the reference (query types, F11):
# type, preferred engines, preferred domains, modifiers, max results.
QUERY_TYPES = [
    ("academic", ["google_custom", "searx"],
     ["scholar.google.com", "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "ieee.org", "acm.org",
      "springer.com", "elsevier.com"],
     ["site:scholar.google.com", "filetype:pdf"], 15),
    ("news", ["google_custom", "bing"],
     ["reuters.com", "bbc.com", "cnn.com", "npr.org", "apnews.com"],
     ["after:2023-01-01"], 10),
    ("technical", ["google_custom", "searx"],
     ["stackoverflow.com", "github.com", "docs.python.org", "developer.mozilla.org",
      "readthedocs.io"],
     ["site:stackoverflow.com OR site:github.com"], 12),
    ("general", ["duckduckgo", "searx"],
     ["wikipedia.org", "britannica.com", "howstuffworks.com"], [], 10),
]

# Fixed values that must equal the reference (rate limits, I1):
# scope, key, limit_type, limit, window s.
RATE_LIMITS = [
    ("global", "*", "requests_per_minute", 100.0, 60),
    ("global", "*", "concurrent_requests", 5.0, 0),
    ("global", "*", "delay_between_requests", 1.0, 0),
    ("domain", "google.com", "requests_per_minute", 10.0, 60),
    ("domain", "google.com", "delay_between_requests", 2.0, 0),
    ("domain", "duckduckgo.com", "requests_per_minute", 30.0, 60),
    ("domain", "duckduckgo.com", "delay_between_requests", 1.0, 0),
    ("domain", "wikipedia.org", "requests_per_minute", 60.0, 60),
    ("domain", "wikipedia.org", "delay_between_requests", 0.5, 0),
    ("domain", "github.com", "requests_per_minute", 60.0, 60),
    ("domain", "github.com", "requests_per_hour", 1000.0, 3600),
    ("domain", "stackoverflow.com", "requests_per_minute", 30.0, 60),
    ("domain", "stackoverflow.com", "delay_between_requests", 1.0, 0),
    ("engine", "duckduckgo", "requests_per_minute", 30.0, 60),
    ("engine", "duckduckgo", "delay_between_requests", 1.0, 0),
    ("engine", "google_custom", "requests_per_minute", 100.0, 60),
    ("engine", "google_custom", "requests_per_day", 1000.0, 86400),
    ("engine", "bing", "requests_per_minute", 1000.0, 60),
    ("engine", "bing", "requests_per_day", 10000.0, 86400),
    ("engine", "searx", "requests_per_minute", 60.0, 60),
    ("engine", "searx", "delay_between_requests", 1.0, 0),
]
BACKOFF_FACTOR = 1.5
MAX_DELAY = 300
DEFAULT_DELAY = 1.0

# Fixed values that must equal the reference (memory profiles, J3): level, k.
MEMORY_PROFILES = [("performance", 20), ("balanced", 10), ("cpu", 5)]

# Preset domains for the derived request log (by user_id % 5).
PRESET_DOMAINS = ["google.com", "duckduckgo.com", "wikipedia.org", "github.com",
                  "stackoverflow.com"]

# event_type -> engine of the derived search log.
EVENT_ENGINE = [("click", "duckduckgo"), ("view", "searx"), ("purchase", "bing"),
                ("signup", "google_custom")]


def page_type_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGE_TYPE_RULES,
                                 "page_type string, min_content_length int, quality_threshold double")


def blocked_domains(spark: SparkSession, extra: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(d,) for d in BLOCKED_DOMAINS + (extra or [])], "name string")


def preferred_domains(spark: SparkSession, extra: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(d,) for d in PREFERRED_DOMAINS + (extra or [])], "name string")


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ENGINES, "engine string, display_name string, requires_api_key boolean, "
                 "enabled boolean, rate_limit_per_minute int, timeout int")


def query_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        QUERY_TYPES, "query_type string, preferred_engines array<string>, "
                     "preferred_domains array<string>, modifiers array<string>, max_results int")


def rate_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RATE_LIMITS, "scope string, key string, limit_type string, `limit` double, window int")


def memory_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMORY_PROFILES, "level string, k int")
