"""Which parser reads which kind of payload, and the choice of sources for a run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.functions.text import slug
from newsweft.operators.skew import top_per_group
from newsweft.sources import feeds, html

# Source kinds.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "arxiv_feed": feeds.paper_entries,
    "bluesky_feed": feeds.post_links,
    "generic_scrape": html.generic_entries,
    "github_trending": html.trending_repos,
    "hackernews_api": feeds.story_items,
    "huggingface_scrape": feeds.daily_papers,
    "lobsters_feed": feeds.hot_stories,
    "mastodon_feed": feeds.toot_links,
    "podcast_rss": feeds.podcast_items,
    "reddit_json": feeds.listing_posts,
    "substack_feed": feeds.rss_items,
    "youtube_rss": feeds.video_entries,
}


def register_parser(kind: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[kind] = parser


def union_sources(*entries: DataFrame) -> DataFrame:
    """All entries, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), entries)


def parse_landed(landed: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Run every registered parser on the payloads of its kind."""
    chosen = kinds or sorted(PARSERS)
    unknown = [k for k in chosen if k not in PARSERS]
    if unknown:
        raise ValueError(f"no parser for {unknown}; known kinds: {sorted(PARSERS)}")
    return union_sources(*[PARSERS[k](landed.filter(F.col("kind") == k)) for k in chosen])


def select_sources(sources: DataFrame, names: DataFrame) -> DataFrame:
    """Requested names matched loosely; ``matched`` is false for names no source answers to."""
    wanted = names.select("name").withColumn("key", slug(F.col("name")))
    keyed = sources.withColumn("key", slug(F.col("name"))).withColumnRenamed("name", "source_name")
    hits = keyed.join(wanted.select("key").distinct(), "key", "left_semi").withColumn(
        "matched", F.lit(True)
    )
    misses = (
        wanted.join(keyed, "key", "left_anti")
        .select("key", F.col("name").alias("source_name"))
        .distinct()
        .withColumn("matched", F.lit(False))
    )
    return hits.unionByName(misses, allowMissingColumns=True).drop("key")


def skip_scraped(sources: DataFrame, source_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources not scraped since the last completed run."""
    last = runs.agg(F.max("completed_at").alias("last_completed"))
    recent = (
        source_runs.join(F.broadcast(last), F.col("last_run_at") > F.col("last_completed"))
        .select(F.col("source_name").alias("name"))
    )
    return sources.join(recent, "name", "left_anti")


def cap_per_source(entries: DataFrame, sources: DataFrame, order: list[str]) -> DataFrame:
    """At most ``max_articles`` entries of each source, in feed order."""
    limits = sources.select(F.col("name").alias("source_name"), "max_articles")
    return top_per_group(
        entries.join(limits, "source_name"),
        ["source_name"],
        [F.col(c) for c in order],
        F.col("max_articles"),
    ).drop("max_articles")
