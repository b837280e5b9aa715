"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions.concepts import UNCATEGORIZED
from newsweft.params import Params


def url_stats(visited: DataFrame, *, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return visited.agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(F.coalesce("passed_relevance", F.lit(False))).alias("passed_relevance"),
        distinct("source_name").alias("sources"),
    )


def briefing_dates(articles: DataFrame) -> DataFrame:
    return (
        articles.groupBy("briefing_date")
        .agg(F.count(F.lit(1)).alias("article_count"))
        .orderBy(F.desc("briefing_date"))
    )


def failure_stats(failures: DataFrame) -> DataFrame:
    """Total, by phase and by error type in one pass: ``scope``, ``value``, ``n``."""
    return (
        failures.groupingSets([[], ["phase"], ["error_type"]], "phase", "error_type")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "phase").otherwise("error_type").alias("scope"),
            F.coalesce("phase", "error_type", F.lit("")).alias("value"),
            "n",
        )
    )


def failure_breakdown(failures: DataFrame) -> DataFrame:
    per_phase = failures.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat("phase", F.lit(": "), "n")
    return per_phase.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failures"),
        F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("breakdown"),
    )


def category_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category")).agg(
        F.count(F.lit(1)).alias("nodes")
    )


def domain_table(nodes: DataFrame) -> DataFrame:
    """Per category: size and most familiar concept (ties: the name that sorts first)."""
    top = F.min_by(
        F.struct("concept", "familiarity"), F.struct(-F.col("familiarity"), F.col("concept"))
    )
    return (
        nodes.groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"))
        .agg(F.count(F.lit(1)).alias("concepts"), top.alias("top"))
        .select(
            "category",
            "concepts",
            F.col("top.concept").alias("top_concept"),
            F.col("top.familiarity").alias("top_familiarity"),
        )
        .orderBy("category")
    )


def run_funnel(
    scanned: DataFrame,
    new: DataFrame,
    passed: DataFrame,
    summaries: DataFrame,
    params: Params,
    *,
    briefed: bool = False,
) -> DataFrame:
    """One row of stage counts and why the run ended early, if it did."""
    tagged = None
    for stage, df in (
        ("scanned", scanned), ("new", new), ("passed", passed), ("summarised", summaries)
    ):
        part = df.select(F.lit(stage).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.agg(
        *[
            F.count_if(F.col("stage") == s).alias(s)
            for s in ("scanned", "new", "passed", "summarised")
        ]
    )
    # The wording of the stop reasons.
    reason = (
        F.when(F.lit(briefed), None)
        .when(F.col("scanned") == 0, "No articles discovered from any source")
        .when(
            F.col("new") == 0,
            "All discovered URLs already visited "
            f"(dedup window: {params.dedup_days}d / briefed: {params.briefed_dedup_days}d)",
        )
        .when(F.col("passed") == 0, "No articles passed the relevance filter")
        .when(F.col("summarised") == 0, "All article reads/summaries failed")
        .otherwise("Briefing generation failed unexpectedly")
    )
    return counts.withColumn("stop_reason", reason)


def briefing_list(articles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Dates newest first, with feedback state and number of articles read."""
    fb = feedback.groupBy("briefing_date").agg(
        F.lit(True).alias("has_feedback"), F.count_if("read").alias("read_count")
    )
    return (
        briefing_dates(articles)
        .join(fb, "briefing_date", "left")
        .select(
            "briefing_date",
            "article_count",
            F.coalesce("has_feedback", F.lit(False)).alias("has_feedback"),
            F.coalesce("read_count", F.lit(0)).alias("read_count"),
        )
        .orderBy(F.desc("briefing_date"))
    )


def briefing_chart(articles: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` dates, oldest first, as a share of the busiest one, at least two percent."""
    last = briefing_dates(articles).limit(n)
    share = F.col("article_count") / F.max("article_count").over(Window.partitionBy()) * 100
    return last.withColumn("height_pct", F.greatest(share, F.lit(2.0))).orderBy("briefing_date")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def last_run(runs: DataFrame) -> DataFrame:
    return (
        runs.filter(F.col("completed_at").isNotNull())
        .orderBy(F.desc("completed_at"), F.desc("run_id"))
        .limit(1)
    )


def pick_briefing(briefings: DataFrame, key: str, today: str) -> DataFrame:
    """``today``/``latest`` is the newest document, ``yesterday`` the day before, else a date."""
    word = key.strip().lower()
    if word in ("today", "latest"):
        return briefings.orderBy(F.desc("briefing_date")).limit(1)
    day = F.lit(today if word == "yesterday" else key.strip()).cast("date")
    if word == "yesterday":
        day = F.date_sub(day, 1)
    return briefings.filter(F.col("briefing_date") == day)


def compare_briefings(articles: DataFrame, left: str, right: str) -> DataFrame:
    """Lower-cased concepts of two dates: ``shared``, ``only_left`` or ``only_right``."""
    is_left = F.col("briefing_date") == F.lit(left).cast("date")
    is_right = F.col("briefing_date") == F.lit(right).cast("date")
    return (
        articles.filter(is_left | is_right)
        .select(F.explode("key_concepts").alias("c"), is_left.alias("l"), is_right.alias("r"))
        .groupBy(F.lower("c").alias("concept"))
        .agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
        .select(
            "concept",
            F.when(F.col("l") & F.col("r"), "shared")
            .when(F.col("l"), "only_left")
            .otherwise("only_right")
            .alias("side"),
        )
        .orderBy("side", "concept")
    )


def kb_stats(
    visited: DataFrame, vectors: DataFrame, graph_size: DataFrame, most_connected: DataFrame
) -> DataFrame:
    """Everything the status page shows, in one row."""
    one = lambda df, c: df.select(c).scalar()
    top = most_connected.select(F.struct("concept", "degree")).scalar()
    return url_stats(visited).select(
        F.col("total_urls").alias("urls_visited"),
        F.col("passed_relevance").alias("urls_passed_relevance"),
        F.col("sources").alias("sources_seen"),
        vectors.agg(F.count(F.lit(1))).scalar().alias("article_embeddings"),
        one(graph_size, "nodes").alias("graph_nodes"),
        one(graph_size, "edges").alias("graph_edges"),
        F.coalesce(top["concept"], F.lit("")).alias("most_connected_topic"),
        F.coalesce(top["degree"], F.lit(0)).alias("most_connected_edges"),
    )
