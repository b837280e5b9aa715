"""Keyed writes as functions ``(current, incoming) -> next``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.text import embed_text, extract_body
from newsweft.operators.checks import MIN_BODY, needs_refetch
from newsweft.operators.skew import first_per_key


def last_per_key(inc: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row that arrived last for each key."""
    return first_per_key(inc, keys, [F.desc(seq)])


def replace_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows (unique by key) replace the current rows of the same key."""
    kept = current.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))


def visits(incoming: DataFrame, now: Column) -> DataFrame:
    """The last visit of each url, with a window that begins now."""
    fresh = last_per_key(incoming, ["url"]).withColumns(
        {"first_seen": now, "was_briefed": F.lit(False)}
    )
    return fresh.drop("seq")


def upsert_visited(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """A new visit overwrites the row and restarts its window."""
    return replace_rows(current, visits(incoming, now), ["url"])


def mark_briefed(current: DataFrame, urls: DataFrame) -> DataFrame:
    listed = urls.select("url").distinct().withColumn("__listed", F.lit(True))
    return (
        current.join(listed, "url", "left")
        .withColumn("was_briefed", F.coalesce("__listed", "was_briefed"))
        .select(*current.columns)
    )


def upsert_articles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace by (date, number); numbers only the current table has survive."""
    return replace_rows(current, incoming, ["briefing_date", "article_number"])


def record_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    return replace_rows(runs, row, ["run_id"])


def source_visits(incoming: DataFrame, now: Column) -> DataFrame:
    return last_per_key(incoming, ["source_name"]).withColumn("last_run_at", now).drop("seq")


def record_source_run(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    return replace_rows(current, source_visits(incoming, now), ["source_name"])


def failure_changes(incoming: DataFrame) -> DataFrame:
    """Per (url, phase): how often it failed, its last error and what it was called first."""
    return incoming.groupBy("url", "phase").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("error_type", "error_message", "run_id"), "seq").alias("last"),
        F.min_by(F.struct("title", "source_name"), "seq").alias("first"),
    )


def upsert_failures(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Each incoming row of a known (url, phase) is one more retry.

    The error comes from the last row, title and source stay those of the first one ever seen.
    """
    key = ["url", "phase"]
    inc = failure_changes(incoming)
    cur = current.withColumn("known", F.lit(True))
    hit = F.col("last").isNotNull()
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old))
    known = F.coalesce("known", F.lit(False))
    return cur.join(inc, key, "full_outer").select(
        *key,
        F.when(known, F.col("title")).otherwise(F.col("first.title")).alias("title"),
        F.when(known, F.col("source_name")).otherwise(F.col("first.source_name")).alias("source_name"),
        pick("last.error_type", "error_type").alias("error_type"),
        pick("last.error_message", "error_message").alias("error_message"),
        F.when(hit, now).otherwise(F.col("failed_at")).alias("failed_at"),
        pick("last.run_id", "run_id").alias("run_id"),
        F.when(~known, F.col("n") - 1)
        .otherwise(F.col("retry_count") + F.coalesce("n", F.lit(0)))
        .cast("long")
        .alias("retry_count"),
    )


def remove_failures(failures: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    if urls is None:
        return failures.limit(0)
    return failures.join(urls.select("url"), "url", "left_anti")


def feedback_changes(incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """Per known article: the last value that is given for each field."""
    key = ["briefing_date", "article_number"]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}")
    inc = incoming.groupBy(*key).agg(last("read"), last("interest"), last("quality"))
    return inc.join(articles.select(*key, F.col("title").alias("article_title")), key)


def merge_feedback(
    current: DataFrame, incoming: DataFrame, articles: DataFrame, now: Column
) -> DataFrame:
    """Fields an update leaves empty keep their value; updates of unknown articles are dropped."""
    key = ["briefing_date", "article_number"]
    inc = feedback_changes(incoming, articles)
    hit = F.col("article_title").isNotNull()
    return current.join(inc, key, "full_outer").select(
        *key,
        F.coalesce("article_title", "title").alias("title"),
        F.coalesce("new_read", "read", F.lit(False)).alias("read"),
        F.coalesce("new_interest", "interest").alias("interest"),
        F.coalesce("new_quality", "quality").alias("quality"),
        F.when(hit, now).otherwise(F.col("processed_at")).alias("processed_at"),
    )


def vector_rows(summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Summaries with their vectors in the shape of the vector table."""
    return summaries.join(embeddings, "url").select(
        "url",
        "embedding",
        "title",
        F.col("source_name").alias("source"),
        F.substring(embed_text(F.col("key_concepts"), F.col("summary")), 1, 500).alias("document"),
        "seq",
    )


def upsert_vectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return replace_rows(current, last_per_key(incoming, ["url"]), ["url"])


def delete_date(
    articles: DataFrame, feedback: DataFrame, visited: DataFrame, date: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo one day: its articles, their feedback and the urls first seen that day."""
    day = F.lit(date).cast("date")
    other = F.col("briefing_date") != day
    return (
        articles.filter(other),
        feedback.filter(other),
        visited.filter(F.to_date("first_seen") != day),
    )


def reextract_bodies(articles: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill broken bodies from newly landed pages; the next table and one row of counts."""
    broken = articles.filter(needs_refetch()).select("briefing_date", "article_number", "url")
    landed = pages.select("url", extract_body(F.col("html")).alias("new_body"))
    tried = broken.join(landed, "url", "left").withColumn(
        "status",
        F.when(F.col("new_body").isNull(), "failed")
        .when(F.length("new_body") < MIN_BODY, "skipped")
        .otherwise("updated"),
    )
    fixed = tried.filter(F.col("status") == "updated").select(
        "briefing_date", "article_number", "new_body"
    )
    nxt = (
        articles.join(fixed, ["briefing_date", "article_number"], "left")
        .withColumns(
            {
                "body_content": F.coalesce("new_body", "body_content"),
                "body_content_type": F.when(
                    F.col("new_body").isNotNull(), F.lit("plaintext")
                ).otherwise(F.col("body_content_type")),
            }
        )
        .select(*articles.columns)
    )
    counts = tried.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("updated", "skipped", "failed")]
    )
    return nxt, counts
