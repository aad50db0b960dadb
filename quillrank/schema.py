"""Schemas of results and stored tables, and the preferences of a request with their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = (
    "query_id long, pos long, url string, domain string, title string, snippet string, content string, word_count int, publish_date string, author string, "
    "source string, from_cache boolean, cached_at timestamp, discovered_via string, is_exploration boolean, wayback_used boolean, outbound_links array<string>"
)
PAGES = (
    "url string, domain string, title string, snippet string, content string, word_count int, score double, publish_date string, author string, "
    "source string, cluster string, cached_at timestamp, query_tags array<string>"
)
DOMAINS = "domain string, page_count long, avg_score double, last_seen timestamp, last_explored timestamp, explored_pages long, exploration_count long"
QUERIES = "query_hash string, query string, intent string, search_count long, last_searched timestamp"
VOTES = "url string, query string, feedback int, ts timestamp"
TABLES = {"pages": PAGES, "domains": DOMAINS, "queries": QUERIES, "votes": VOTES}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema: absent ones become null, so old tables can be read after columns were added."""
    want = empty(df.sparkSession, schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


@dataclass(frozen=True)
class SearchPrefs:
    """What a request asks for. Values out of their ranges raise ValueError."""

    query: str
    underground_bias: float = 0.5
    freshness_bias: float = 0.5
    exclude_corporate: bool = False
    forums_only: bool = False
    long_form_only: bool = False
    deep_crawl: bool = False
    deseo_mode: bool = False
    forums_priority: bool = False
    use_cache: bool = True
    seed_expand: bool = False
    domain_explore: bool = False
    max_results: int = 20

    def __post_init__(self):
        if not isinstance(self.query, str) or not 1 <= len(self.query) <= 500:
            raise ValueError("query: 1 to 500 characters")
        for name in ("underground_bias", "freshness_bias"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name}: 0 to 1")
        if not 1 <= self.max_results <= 50:
            raise ValueError("max_results: 1 to 50")
        for f in fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name}: true or false")


def check_vote(url: str, query: str, feedback: int) -> None:
    """Raise unless a vote is well formed; 0 is in range but no vote."""
    if not 1 <= len(url) <= 2000 or not 1 <= len(query) <= 500:
        raise ValueError("url: 1 to 2000 characters; query: 1 to 500 characters")
    if feedback not in (-1, 0, 1):
        raise ValueError("feedback: -1 to 1")
