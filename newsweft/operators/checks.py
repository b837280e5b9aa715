"""Row filters, gates and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import scoring
from newsweft.functions.text import (
    CSS_RESIDUE,
    extract_json,
    is_mostly_cjk,
    usable_html,
)

MIN_BODY = 100


def drop_cjk(entries: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Entries whose title and snippet are not mostly written in Han characters."""
    foreign = is_mostly_cjk(F.col("title"), threshold) | is_mostly_cjk(F.col("snippet"), threshold)
    return entries.filter(~foreign)


def keep_usable_html(pages: DataFrame) -> DataFrame:
    return pages.filter(usable_html(F.col("html")))


def failure_columns(phase: str, error_type: Column | str, message: Column) -> list[Column]:
    kind = F.lit(error_type) if isinstance(error_type, str) else error_type
    return [
        F.lit(phase).alias("phase"),
        kind.alias("error_type"),
        message.alias("error_message"),
    ]


def body_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``body`` long enough to read, and failure rows for the others."""
    n = F.length(F.coalesce("body", F.lit("")))
    message = F.format_string("Extracted body too short (%d chars)", n)
    ok = df.filter(n >= MIN_BODY)
    failed = df.filter(n < MIN_BODY).select(
        "url", "title", "source_name", *failure_columns("fetch", "parse_error", message)
    )
    return ok, failed


def needs_refetch() -> Column:
    body = F.coalesce("body_content", F.lit(""))
    return (F.length(body) < MIN_BODY) | F.substring(body, 1, 500).rlike(CSS_RESIDUE)


def refetch_candidates(articles: DataFrame) -> DataFrame:
    return articles.filter(needs_refetch()).orderBy(F.desc("briefing_date"), "article_number")


def search_articles(articles: DataFrame, text: str) -> DataFrame:
    """Case-insensitive containment in title, summary or body; ``%`` and ``_`` are wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for c in ("title", "summary", "body_content"):
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return (
        articles.filter(hit)
        .drop("body_content")
        .orderBy(F.desc("briefing_date"), "article_number")
    )


def articles_by_date(articles: DataFrame, date: str) -> DataFrame:
    day = F.lit(date).cast("date")
    return articles.filter(F.col("briefing_date") == day).drop("body_content").orderBy("article_number")


def get_article(articles: DataFrame, date: str, number: int) -> DataFrame:
    day = F.lit(date).cast("date")
    return articles.filter((F.col("briefing_date") == day) & (F.col("article_number") == number))


def exists_in(keys: DataFrame, table: DataFrame, on: list[str], name: str = "found") -> DataFrame:
    """Mark each key row with whether ``table`` has it."""
    present = table.select(*on).distinct().withColumn(name, F.lit(True))
    return keys.join(present, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def annotate_novelty(df: DataFrame) -> DataFrame:
    g = F.col("graph_novelty")
    return df.withColumns(
        {
            "is_deepening": scoring.is_deepening(g),
            "novelty_explanation": F.coalesce(scoring.novelty_explanation(g), F.lit("")),
        }
    )


def pending_failures(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    return failures.filter(F.col("retry_count") < max_retries).orderBy("failed_at")


def parse_model_output(df: DataFrame, schema: str) -> DataFrame:
    """Decode the ``raw`` answer of a model into ``parsed``; NULL when it is no such object."""
    return df.withColumn("parsed", F.from_json(extract_json(F.col("raw")), schema))


def _split_valid(df: DataFrame, valid: Column, phase: str) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    bad = flagged.filter(~F.col("__ok")).drop("__ok", "parsed")
    failed = bad.select(
        *bad.columns,
        *failure_columns(phase, "parse_error", F.lit("Model output does not match the schema")),
    ).drop("raw")
    return flagged.filter("__ok").drop("__ok", "raw"), failed


def validate_scores(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevance answers: a whole score of 0 to 10 and a justification."""
    parsed = parse_model_output(df, "score double, justification string")
    p = F.col("parsed")
    whole = p["score"].between(0, 10) & (F.floor(p["score"]) == p["score"])
    ok, failed = _split_valid(parsed, whole & p["justification"].isNotNull(), "filter")
    ok = ok.select(
        *[c for c in ok.columns if c != "parsed"],
        p["score"].cast("int").alias("score"),
        p["justification"].alias("justification"),
    ).drop("parsed")
    return ok, failed


def validate_summaries(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Summary answers: every field present, depth 1 to 5, a missing date filled with ``now``."""
    schema = (
        "title string, source_name string, url string, date_processed string, "
        "key_concepts array<string>, summary string, novel_insights string, technical_depth double, "
        "related_topics array<string>, relationships array<struct<`from`:string,`to`:string,type:string>>"
    )
    p = F.col("parsed")
    valid = p["technical_depth"].between(1, 5) & (
        F.floor(p["technical_depth"]) == p["technical_depth"]
    )
    for c in (
        "title", "source_name", "url", "key_concepts", "summary", "novel_insights", "related_topics"
    ):
        valid = valid & p[c].isNotNull()
    dated = F.coalesce(p["date_processed"], F.lit(""))
    when = dated.try_cast("timestamp")
    valid = valid & ((dated == "") | when.isNotNull())
    ok, failed = _split_valid(parse_model_output(df, schema), valid, "summarize")
    keep = [c for c in df.columns if c not in ("raw", "title", "source_name", "url")]
    ok = ok.select(
        *keep,
        *[p[c].alias(c) for c in ("title", "source_name", "url")],
        F.coalesce(when, now).alias("date_processed"),
        *[p[c].alias(c) for c in ("key_concepts", "summary", "novel_insights")],
        p["technical_depth"].cast("int").alias("technical_depth"),
        p["related_topics"].alias("related_topics"),
        F.coalesce(
            p["relationships"],
            F.array().cast("array<struct<`from`:string,`to`:string,type:string>>"),
        ).alias("relationships"),
    )
    return ok, failed
