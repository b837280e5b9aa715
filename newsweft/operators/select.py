"""Dedup windows, quotas, ranking and assembly of a day's articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import scoring
from newsweft.operators.skew import first_per_key, number_rows
from newsweft.params import Params


def seen_recently(visited: DataFrame, now: Column, params: Params) -> DataFrame:
    """Urls still inside their window; a window of zero days never ends."""
    if params.dedup_days <= 0:
        return visited.select("url")
    age = lambda days: now - F.make_dt_interval(F.lit(days))
    briefed = F.coalesce("was_briefed", F.lit(False))
    limit = F.when(briefed, age(params.briefed_dedup_days)).otherwise(age(params.dedup_days))
    return visited.filter(F.col("first_seen") > limit).select("url")


def filter_new(entries: DataFrame, visited: DataFrame, now: Column, params: Params) -> DataFrame:
    """Entries not seen inside their window; repeats within the batch stay."""
    return entries.join(seen_recently(visited, now, params), "url", "left_anti")


def url_difference(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.select("url").distinct().join(known.select("url"), "url", "left_anti")


def adaptive_threshold(new_entries: DataFrame, params: Params) -> DataFrame:
    """One row: the pool size and the relevance threshold it leads to."""
    t, low = params.relevance_threshold, params.min_items
    pool = F.col("pool")
    value = (
        F.when(pool < 2 * low, max(3, t - 2)).when(pool < 3 * low, max(4, t - 1)).otherwise(t)
    )
    return new_entries.agg(F.count(F.lit(1)).alias("pool")).withColumn(
        "threshold", value.cast("int")
    )


def split_relevance(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """Add ``passed`` from the one-row threshold."""
    limit = threshold.select("threshold").scalar()
    return scored.withColumn("passed", F.col("score") >= limit)


def no_filter(entries: DataFrame) -> DataFrame:
    return entries.withColumns(
        {
            "score": F.lit(10),
            "justification": F.lit("filter skipped"),
            "passed": F.lit(True),
        }
    )


def visited_rows(new_entries: DataFrame, scored: DataFrame) -> DataFrame:
    """Visit rows of a scoring round: scored entries, and the unscored ones as not passed."""
    cols = ["url", "title", "source_name", "seq"]
    done = scored.select(
        *cols, F.col("passed").alias("passed_relevance"), F.col("score").alias("relevance_score")
    )
    missing = new_entries.join(scored.select("url"), "url", "left_anti").select(
        *cols,
        F.lit(False).alias("passed_relevance"),
        F.lit(None).cast("int").alias("relevance_score"),
    )
    return done.unionByName(missing)


def quota_select(scored: DataFrame, params: Params) -> DataFrame:
    """Articles to read (``passed``) and those kept for backfill (``reserve``).

    All that pass, or the best ones up to the minimum, capped at the maximum; the next best form
    the reserve. Passing scores lie above the others, so both are runs of one ranking and only its
    first ``max_items + min_items`` rows are ever sorted out.
    """
    low, high = params.min_items, params.max_items
    best = scored.orderBy(F.desc("score"), "seq").limit(high + low)
    ranked = best.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")).cast("int")
    )
    wanted = scored.agg(
        F.least(F.greatest(F.count_if("passed"), F.lit(low)), F.lit(high)).cast("int")
    ).scalar()
    return (
        ranked.withColumn("n", wanted)
        .withColumn(
            "role",
            F.when(F.col("rank") <= F.col("n"), "passed").when(
                F.col("rank") <= F.col("n") + low, "reserve"
            ),
        )
        .filter(F.col("role").isNotNull())
        .drop("n")
    )


def reader_backfill(summaries: DataFrame, reserve: DataFrame, params: Params) -> DataFrame:
    """Reserve rows to read when too few summaries came out: the shortfall plus two."""
    n = summaries.agg(F.count(F.lit(1)).cast("int")).scalar()
    first = reserve.agg(F.min("rank")).scalar()
    return (
        reserve.withColumns({"__short": F.lit(params.min_items) - n, "__first": first})
        .filter((F.col("__short") > 0) & (F.col("rank") - F.col("__first") < F.col("__short") + 2))
        .drop("__short", "__first")
    )


def extend_passed(passed: DataFrame, reserve: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add the reserve rows that did get a summary."""
    used = reserve.join(summaries.select("url"), "url", "left_semi")
    return passed.unionByName(used)


def drop_near_duplicates(novelty: DataFrame) -> DataFrame:
    return novelty.filter(~scoring.is_near_duplicate(F.col("vector_novelty")))


def rank_by_final(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("final_score"), "seq")


def novelty_select(summaries: DataFrame, novelty: DataFrame, params: Params) -> DataFrame:
    """Summaries that are no near-duplicates, best first; the best duplicates fill up to the minimum."""
    flags = novelty.select("url", "is_near_duplicate", "final_score")
    rows = summaries.join(flags, "url", "left").withColumns(
        {
            "is_near_duplicate": F.coalesce("is_near_duplicate", F.lit(False)),
            "final_score": F.coalesce("final_score", F.lit(0.0)),
        }
    )
    order = [F.desc("final_score"), F.col("seq")]
    fresh = rows.filter(~F.col("is_near_duplicate"))
    n = fresh.agg(F.count(F.lit(1)).cast("int")).scalar()
    spare = (
        rows.filter("is_near_duplicate")
        .orderBy(*order)
        .limit(params.min_items)
        .withColumn("__rn", F.row_number().over(Window.orderBy(*order)))
        .withColumn("__short", F.lit(params.min_items) - n)
        .filter(F.col("__rn") <= F.col("__short"))
        .drop("__rn", "__short")
    )
    return rank_by_final(fresh.unionByName(spare))


def first_by_url(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["url"], [F.col("seq")])


def number_articles(df: DataFrame) -> DataFrame:
    """1..n per date in rank order."""
    return number_rows(df, ["briefing_date"], [F.col("rank")], "article_number")


def number_briefing(df: DataFrame) -> DataFrame:
    """1..n per date, new topics before deepening ones."""
    return number_rows(
        df, ["briefing_date"], [F.col("is_deepening"), F.col("rank")], "article_number"
    )


def assemble_articles(summaries: DataFrame, novelty: DataFrame, relevance: DataFrame) -> DataFrame:
    """Summaries with their scores; whatever is missing counts as zero."""
    n = novelty.select("url", "novelty_score", "graph_novelty", "vector_novelty")
    joined = summaries.join(n, "url", "left").join(
        relevance.select("url", "relevance_score"), "url", "left"
    )
    g = F.col("graph_novelty")
    return joined.withColumns(
        {
            "is_deepening": scoring.is_deepening(g),
            "novelty_explanation": F.coalesce(scoring.novelty_explanation(g), F.lit("")),
            "relevance_score": F.coalesce("relevance_score", F.lit(0)),
            "novelty_score": F.coalesce("novelty_score", F.lit(0.0)),
            "graph_novelty": F.coalesce("graph_novelty", F.lit(0.0)),
            "vector_novelty": F.coalesce("vector_novelty", F.lit(0.0)),
        }
    )


def new_articles_today(
    entries: DataFrame, visited: DataFrame, now: Column, params: Params
) -> DataFrame:
    """Unseen, readable, first-of-their-url entries."""
    from newsweft.operators.checks import drop_cjk

    return first_by_url(drop_cjk(filter_new(entries, visited, now, params)))
