"""Briefing documents as tables: rendering, parsing back, migration and linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import briefing_text as B
from newsweft.functions.concepts import loose_key
from newsweft.functions.text import (
    format_duration,
    let,
    lines,
    safe_filename,
)

PRODUCT = "Newsweft"
# Sentences of the briefing format.
EMPTY = "*No articles to include in today's briefing.*"
DEEPENING_NOTE = "> Articles on topics you know, but with a new angle."
CONCEPTS_NOTE = "> Topics appearing for the first time in your knowledge graph."
EXPLORE_NOTE = "> Topics adjacent to your knowledge that you have not explored yet."
FEEDBACK_NOTE = "> Rate articles after reading. Processed automatically on the next run."
FEEDBACK_KEYS = "> read: yes/no | interest: 1-5 | quality: like/meh/dislike/broken"


def parse_briefing(briefings: DataFrame) -> DataFrame:
    """Article rows of each ``(briefing_date, md)``."""
    return briefings.select("briefing_date", F.inline(B.parse_articles(F.col("md"))))


def parse_feedback(briefings: DataFrame) -> DataFrame:
    return briefings.select("briefing_date", F.inline(B.parse_feedback(F.col("md"))))


def feedback_with_articles(briefings: DataFrame) -> DataFrame:
    """Filled-in feedback with the title and concepts of the article it numbers.

    A document's headings are read once, not again for each of its rows.
    """
    given = lambda f: f["read"] | f["interest"].isNotNull() | f["quality"].isNotNull()

    def about(heads: Column, f: Column) -> Column:
        of = F.filter(heads, lambda h: h["article_number"] == f["article_number"])
        return let(
            B._last(of),
            lambda m: F.struct(
                f["article_number"].alias("article_number"),
                F.coalesce(m["title"], F.lit("")).alias("title"),
                F.coalesce(m["concepts"], F.array().cast("array<string>")).alias("concepts"),
                f["read"].alias("read"),
                f["interest"].alias("interest"),
                f["quality"].alias("quality"),
            ),
        )

    rows = lambda md: let(
        B.heading_metadata(md),
        lambda heads: F.transform(F.filter(B.parse_feedback(md), given), lambda f: about(heads, f)),
    )
    return briefings.select("briefing_date", F.inline(let(F.col("md"), rows)))


def unprocessed_briefings(briefings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Documents with a feedback form whose date has no feedback yet."""
    done = feedback.select("briefing_date").distinct()
    return briefings.filter(F.contains("md", F.lit(B.FEEDBACK_HEADING))).join(
        done, "briefing_date", "left_anti"
    )


def migrate_briefings(briefings: DataFrame, articles: DataFrame) -> DataFrame:
    """Article rows of documents whose date the article table does not have."""
    fresh = briefings.join(
        articles.select("briefing_date").distinct(), "briefing_date", "left_anti"
    )
    return parse_briefing(fresh).select(
        "briefing_date", "article_number", "title", "source_name", "url", "summary",
        "novel_insights", "key_concepts", "related_topics", "relevance_score",
        (F.col("novelty_pct") / 100.0).alias("novelty_score"),
        F.lit(0.0).alias("graph_novelty"),
        F.lit(0.0).alias("vector_novelty"),
        "novelty_explanation",
        F.lit(0).alias("technical_depth"),
        "is_deepening",
        F.lit("").alias("body_content"),
        F.lit("plaintext").alias("body_content_type"),
    )


def briefing_detail(articles: DataFrame, briefings: DataFrame, date: str | None = None) -> DataFrame:
    """Articles of one date, or of all, with what their document says about the run."""
    if date is not None:
        day = F.lit(date).cast("date")
        articles = articles.filter(F.col("briefing_date") == day)
        briefings = briefings.filter(F.col("briefing_date") == day)
    meta = briefings.select("briefing_date", B.briefing_metadata(F.col("md")).alias("meta"))
    bodyless = [c for c in articles.columns if c != "body_content"]
    return articles.select(*bodyless).join(meta, "briefing_date", "left")


def _rows(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def _lines(*texts) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in texts])


_NONE = "array<string>"


def _if(cond: Column, rows: Column) -> Column:
    return F.when(cond, rows).otherwise(F.array().cast(_NONE))


def _ticked(concepts: Column) -> Column:
    return F.array_join(F.transform(concepts, lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", ")


def _read_on() -> list:
    return ["", F.concat(F.lit("[Read original]("), F.col("url"), F.lit(")")), "", "---", ""]


def _novel_block() -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.flatten(
        F.array(
            _lines(
                F.format_string("### %d. %s", "article_number", "title"),
                F.format_string(
                    "**Source**: %s | **Relevance**: %d/10 | **Novelty**: %d%%",
                    "source_name", "relevance_score", (F.col("novelty_score") * 100).cast("int"),
                ),
            ),
            _if(
                text(F.col("novelty_explanation")) != "",
                _lines(F.concat(F.lit("**Why it is new to you**: "), "novelty_explanation")),
            ),
            _lines("", F.col("summary"), ""),
            _if(
                text(F.col("novel_insights")) != "",
                _lines(F.concat(F.lit("**Novel insights**: "), "novel_insights"), ""),
            ),
            _lines(F.concat(F.lit("**Key Concepts**: "), _ticked(F.col("key_concepts")))),
            _if(
                F.size("related_topics") > 0,
                _lines(
                    F.concat(F.lit("**Related Topics**: "), F.array_join("related_topics", ", "))
                ),
            ),
            _lines(*_read_on()),
        )
    )


def _deepening_block() -> Column:
    known = _ticked(F.slice("key_concepts", 1, 3))
    return F.flatten(
        F.array(
            _lines(
                F.format_string("### %d. %s", "article_number", "title"),
                F.concat(
                    F.lit("**What you already know**: You have encountered "), known, F.lit(" before.")
                ),
            ),
            _if(
                F.coalesce("novel_insights", F.lit("")) != "",
                _lines(F.concat(F.lit("**What is new here**: "), "novel_insights")),
            ),
            _lines(*_read_on()),
        )
    )


def _per_date(df: DataFrame, order: str, block: Column, name: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return df.groupBy("briefing_date").agg(
        F.flatten(F.transform(listed, lambda x: x["b"])).alias(name)
    )


def render_briefing(
    runs: DataFrame,
    articles: DataFrame,
    new_concepts: DataFrame,
    explorations: DataFrame,
    *,
    product: str = PRODUCT,
) -> DataFrame:
    """One document per row of ``runs``.

    ``runs``: briefing_date, articles_scanned, articles_relevant, duration_s, nodes_added,
    new_names (the first ten are shown), edges_added, total_nodes, most_connected,
    most_connected_edges. ``articles`` are numbered rows of the day's selection, which the quotas
    bound; ``new_concepts``: briefing_date, pos, concept, title; ``explorations``: briefing_date,
    pos, topic, reason.
    """
    deep = F.col("is_deepening")
    form = _lines(
        F.format_string("**%d. %s**", "article_number", "title"),
        F.format_string("- %d: read=, interest=, quality=", "article_number"),
    )
    parts = [
        _per_date(articles.filter(~deep), "article_number", _novel_block(), "novel"),
        _per_date(articles.filter(deep), "article_number", _deepening_block(), "deepening"),
        _per_date(articles, "article_number", form, "form"),
        articles.groupBy("briefing_date").agg(F.count(F.lit(1)).cast("int").alias("n")),
        _per_date(
            new_concepts,
            "pos",
            _lines(
                F.format_string('- **%s**: First encountered in "%s"', "concept", "title")
            ),
            "concepts",
        ),
        _per_date(
            explorations,
            "pos",
            _lines(F.format_string("%d. **%s** -- %s", "pos", "topic", "reason")),
            "tips",
        ),
    ]
    # the parts are grouped by date already, so merging them shuffles nothing more; broadcasting them
    # would leave the texts to as few tasks as the small table of runs has
    df = reduce(lambda a, b: a.join(b.hint("merge"), "briefing_date", "left"), parts, runs)
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    rows = lambda c: F.coalesce(c, F.array().cast(_NONE))
    n = F.coalesce("n", F.lit(0))
    names = F.array_join(F.slice("new_names", 1, 10), ", ")
    md = _rows(
        _lines(
            F.concat(F.lit(f"# {product} Daily Briefing -- "), F.col("briefing_date").cast("string")),
            "",
            F.format_string(
                "**Articles Scanned**: %d | **Passed Relevance**: %d | **In Briefing**: %d",
                "articles_scanned", "articles_relevant", n,
            ),
            F.concat(F.lit("**Pipeline Runtime**: "), format_duration(F.col("duration_s"))),
            "",
            "---",
            "",
        ),
        _if(has("novel"), F.concat(_lines("## Top Articles", ""), rows("novel"))),
        _if(
            has("deepening"),
            F.concat(_lines(f"## {B.DEEPENING}", DEEPENING_NOTE, ""), rows("deepening")),
        ),
        _if(
            has("concepts"),
            F.concat(_lines("## New Concepts", CONCEPTS_NOTE, ""), rows("concepts"), _lines("", "---", "")),
        ),
        _lines(
            "## Knowledge Graph Update",
            F.format_string(
                "- **Nodes added**: %d (%s)",
                "nodes_added", F.when(F.size("new_names") > 0, names).otherwise("none"),
            ),
            F.format_string("- **Edges added**: %d", "edges_added"),
            F.format_string("- **Total knowledge nodes**: %d", "total_nodes"),
        ),
        _if(
            F.coalesce("most_connected", F.lit("")) != "",
            _lines(
                F.format_string(
                    "- **Most connected topic**: %s (%d connections)",
                    "most_connected", "most_connected_edges",
                )
            ),
        ),
        _lines(""),
        _if(
            has("tips"),
            F.concat(_lines("## Suggested Explorations", EXPLORE_NOTE, ""), rows("tips"), _lines("")),
        ),
        F.concat(
            _lines("---", "", B.FEEDBACK_HEADING, FEEDBACK_NOTE, FEEDBACK_KEYS, ""),
            rows("form"),
            _lines(""),
        ),
    )
    empty = _rows(
        _lines(
            F.concat(F.lit(f"# {product} Daily Briefing -- "), F.col("briefing_date").cast("string")),
            "",
            F.format_string(
                "**Articles Scanned**: %d | **Passed Relevance**: %d | **In Briefing**: 0",
                "articles_scanned", "articles_relevant",
            ),
            F.concat(F.lit("**Pipeline Runtime**: "), format_duration(F.col("duration_s"))),
            "",
            "---",
            "",
            EMPTY,
        )
    )
    return df.select("briefing_date", F.when(n > 0, md).otherwise(empty).alias("md"))


def link_concepts(ticks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``node`` to rows with a ``tick``: looked up as written, then without spaces."""
    names = nodes.select(F.lower("concept").alias("key"), F.col("concept").alias("node"))
    names = names.groupBy("key").agg(F.max("node").alias("node"))
    as_written = names.select(F.col("key").alias("k1"), F.col("node").alias("node1"))
    squeezed = names.select(F.col("key").alias("k2"), F.col("node").alias("node2"))
    return (
        ticks.withColumn("k1", loose_key(F.col("tick")))
        .withColumn("k2", F.replace("k1", F.lit(" "), F.lit("")))
        .join(as_written, "k1", "left")
        .join(squeezed, "k2", "left")
        .withColumn("node", F.coalesce("node1", "node2"))
        .drop("k1", "k2", "node1", "node2")
    )


def link_briefings(briefings: DataFrame, nodes: DataFrame, *, tag: str = "newsweft") -> DataFrame:
    """Front matter on top and the concepts on Key Concepts lines as wikilinks."""
    label = r"\*\*Key Concepts\*\*:[^\n]*"
    ticks = (
        briefings.select(
            "briefing_date",
            F.posexplode(F.regexp_extract_all("md", F.lit(f"({label})"), F.lit(1))).alias("row", "text"),
        )
        .select(
            "briefing_date",
            "row",
            F.posexplode(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1))).alias("i", "tick"),
        )
    )
    link = F.when(
        F.col("node").isNotNull(),
        F.concat(F.lit("[["), safe_filename(F.col("node")), F.lit("|"), "tick", F.lit("]]")),
    ).otherwise(F.concat(F.lit("`"), "tick", F.lit("`")))
    per_row = (
        link_concepts(ticks, nodes)
        .groupBy("briefing_date", "row")
        .agg(F.array_sort(F.collect_list(F.struct("i", link.alias("l")))).alias("ls"))
        .withColumn("linked", F.array_join(F.transform("ls", lambda x: x["l"]), ", "))
    )
    per_date = per_row.groupBy("briefing_date").agg(
        F.map_from_entries(F.collect_list(F.struct("row", "linked"))).alias("links")
    )
    prefix = r"^(\*\*Key Concepts\*\*:\s*)"

    def rebuild(parts: Column) -> Column:
        # text before each label, and the labelled rows between them
        swapped = F.transform(
            parts["rows"],
            lambda r, i: F.coalesce(
                F.concat(F.regexp_extract(r, prefix, 1), F.get(parts["new"], i)), r
            ),
        )
        return F.array_join(
            F.zip_with(parts["text"], swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
        )

    rows = F.regexp_extract_all("md", F.lit(f"({label})"), F.lit(1))
    new = F.transform(rows, lambda r, i: F.col("links")[i])
    text = F.split("md", label)
    linked = let(
        F.struct(rows.alias("rows"), new.alias("new"), text.alias("text")), rebuild
    )
    front = F.concat(
        F.lit(f"---\ntags:\n  - {tag}/briefing\n"),
        F.coalesce(F.concat(F.lit("date: "), F.col("briefing_date").cast("string"), F.lit("\n")), F.lit("")),
        F.lit("---\n"),
    )
    return briefings.join(per_date, "briefing_date", "left").select(
        "briefing_date",
        F.concat(F.when(F.col("md").startswith("---"), F.lit("")).otherwise(front), linked).alias("md"),
    )
