"""The graph as linked notes: one page per concept and category, and an index.

A list is one page, however long. Where lists grow beyond what one task should put together (neighbours
of a hub, concepts of a category, the index), ``page_size`` cuts them into continuation pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.concepts import UNCATEGORIZED, category_color
from newsweft.functions.text import safe_filename
from newsweft.operators.graph import (
    article_ends,
    article_neighbours,
    counted_ends,
    degree,
    edge_count,
    mentioned_neighbours,
    neighbour_rows,
    node_sources,
    top_of,
    with_degree,
)
from newsweft.operators.skew import number_rows
from newsweft.operators.stats import domain_table

def _pages(rows: DataFrame, keys: list[str], order: str, line: Column, name: str, page_size: int | None) -> DataFrame:
    """``(keys, page, name)``: the lines of each group in order, ``page_size`` to a page."""
    rows = rows.withColumn("__line", line)
    if page_size is None:
        numbered = rows.withColumn("page", F.lit(0)).withColumn("__n", F.col(order))
    else:
        numbered = number_rows(rows, keys, [F.col(order)], "__n")
        numbered = numbered.withColumn("page", F.expr(f"(__n - 1) div {page_size}").cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__line").alias("l"))))
    return (
        numbered.groupBy(*keys, "page")
        .agg(F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias(name))
    )


def _page_path(stem: Column) -> Column:
    suffix = F.when(F.col("page") == 0, "").otherwise(
        F.concat(F.lit(" ("), F.col("page") + 1, F.lit(")"))
    )
    return F.concat(stem, suffix, F.lit(".md"))


def _link(name: Column) -> Column:
    return F.concat(F.lit("[["), safe_filename(name), F.lit("|"), name, F.lit("]]"))


def _link_line(name: Column) -> Column:
    return F.concat(F.lit("- "), _link(name))


def _table_link(name: Column) -> Column:
    return F.concat(F.lit("[["), safe_filename(name), F.lit(r"\|"), name, F.lit("]]"))


def _percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def _with_category(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))


def render_concept_notes(
    nodes: DataFrame, edges: DataFrame, sources: DataFrame, *, tag: str = "newsweft", page_size: int | None = None
) -> DataFrame:
    """``(path, page, content)`` of the concept pages."""
    near = neighbour_rows(nodes, edges).drop("first_seen")
    links = _pages(near, ["concept"], "neighbour", _link_line(F.col("neighbour")), "links", page_size)
    return _concept_pages(degree(nodes, edges).join(links, "concept", "left"), sources, tag)


def render_mentioned_notes(
    nodes: DataFrame, occ: DataFrame, *, tag: str = "newsweft", page_size: int | None = None
) -> DataFrame:
    """``render_concept_notes`` of the graph that the mentions make; ``nodes`` are the concepts they name.

    A concept's neighbours and articles come from the rows of its mentions, without pairs or edges.
    """
    if page_size is None:
        links = F.array_join(F.transform(F.sort_array("near"), _link_line), "\n").alias("links")
        ends = F.size("near") + F.array_contains("near", F.col("concept")).cast("int")
        linked = mentioned_neighbours(occ).select("concept", ends.alias("degree"), F.lit(0).alias("page"), links)
    else:
        near = article_neighbours(occ).select("concept", F.explode("near").alias("neighbour")).distinct()
        ends = near.groupBy("concept").agg(F.sum(F.when(F.col("neighbour") == F.col("concept"), 2).otherwise(1)).alias("degree"))
        links = _pages(near, ["concept"], "neighbour", _link_line(F.col("neighbour")), "links", page_size)
        linked = ends.join(links, "concept")
    rows = nodes.join(linked, "concept", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return _concept_pages(rows, article_ends(occ), tag)


def _concept_pages(nodes: DataFrame, sources: DataFrame, tag: str) -> DataFrame:
    """The pages of nodes that have their degree and, for each ``page``, their ``links``."""
    urls = node_sources(sources, 20).groupBy("concept").agg(
        F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("u")
    )
    urls = urls.select(
        "concept",
        F.array_join(F.transform("u", lambda x: F.concat(F.lit("- "), x["url"])), "\n").alias("urls"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    head = F.concat(
        F.lit(f"---\ntags:\n  - {tag}/concept\ncategory: \""), "category", F.lit('"\n'),
        F.format_string(
            "familiarity: %.2f\nencounters: %d\nconnections: %d\n",
            "familiarity", "encounter_count", "degree",
        ),
        F.coalesce(F.concat(F.lit("first_seen: "), day("first_seen"), F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("last_seen: "), day("last_seen"), F.lit("\n")), F.lit("")),
        F.lit("---\n\n# "), "concept", F.lit("\n\n**Familiarity**: "), _percent(F.col("familiarity")),
        F.format_string(" | **Encounters**: %d | **Connections**: %d\n", "encounter_count", "degree"),
    )
    first = F.col("page") == 0
    listed = F.coalesce(
        F.concat(F.lit("\n## Related Concepts\n\n"), "links", F.lit("\n")), F.lit("")
    )
    cited = F.coalesce(F.concat(F.lit("\n## Source Articles\n\n"), "urls", F.lit("\n")), F.lit(""))
    return (
        _with_category(nodes)
        .join(urls, "concept", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
        .select(
            _page_path(
                F.concat(
                    F.lit("Concepts/"), safe_filename(F.col("category")), F.lit("/"),
                    safe_filename(F.col("concept")),
                )
            ).alias("path"),
            "page",
            F.when(first, F.concat(head, listed, cited)).otherwise(listed).alias("content"),
        )
    )


def render_category_pages(nodes: DataFrame, *, tag: str = "newsweft", page_size: int | None = None) -> DataFrame:
    """``(path, page, content)`` of the category pages."""
    rows = _with_category(nodes)
    line = F.concat(
        F.lit("- "), _link(F.col("concept")), F.lit(" (familiarity: "),
        _percent(F.col("familiarity")), F.format_string(", %d encounters)", "encounter_count"),
    )
    pages = _pages(rows, ["category"], "concept", line, "listed", page_size)
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    head = F.concat(
        F.lit(f"---\ntags:\n  - {tag}/category\ncategory: \""), "category", F.lit('"\ncolor: "'),
        category_color(F.col("category")), F.format_string('"\nnode_count: %d\n---\n\n# ', "n"),
        "category", F.format_string("\n\n%d concepts in this domain.\n\n## Concepts\n\n", "n"),
    )
    return pages.join(sizes, "category").select(
        _page_path(
            F.concat(F.lit("Concepts/"), safe_filename(F.col("category")), F.lit("/_Category"))
        ).alias("path"),
        "page",
        F.concat(
            F.when(F.col("page") == 0, head).otherwise(F.lit("")), "listed", F.lit("\n")
        ).alias("content"),
    )


def _top_table(df: DataFrame, line: Column, order: list[Column]) -> DataFrame:
    """The lines of a short ranked table as one row."""
    key = F.struct(*order, F.col("concept").alias("c"))
    listed = F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("l"))))
    return df.agg(F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias("t"))


def render_index(
    nodes: DataFrame, edges: DataFrame, today: str, *, tag: str = "newsweft", page_size: int | None = None
) -> DataFrame:
    """``(path, page, content)`` of the overview."""
    rows = _with_category(nodes)
    domain = F.concat(
        F.lit("| [[Concepts/"), safe_filename(F.col("category")), F.lit(r"/_Category\|"), "category",
        F.format_string("]] | %d | ", "concepts"), _table_link(F.col("top_concept")),
        F.lit(" ("), _percent(F.col("top_familiarity")), F.lit(") |"),
    )
    per_domain = domain_table(rows).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("category", domain.alias("l")))), lambda x: x["l"]
            ),
            "\n",
        ).alias("t")
    )
    fam = F.concat(
        F.lit("| "), _table_link(F.col("concept")), F.lit(" | "), _percent(F.col("familiarity")),
        F.format_string(" | %d | %d |", "encounter_count", "degree"),
    )
    deg = F.concat(
        F.lit("| "), _table_link(F.col("concept")), F.format_string(" | %d | ", "degree"),
        _percent(F.col("familiarity")), F.lit(" |"),
    )
    by = lambda c: [(-F.col(c)).alias("o"), F.col("first_seen")]
    ends = counted_ends(edges)
    ranked = with_degree(rows, ends)
    top_fam = _top_table(top_of(ranked, "familiarity", 20), fam, by("familiarity"))
    top_deg = _top_table(top_of(ranked, "degree", 20), deg, by("degree"))
    entry = F.concat(
        F.lit("- "), _link(F.col("concept")), F.format_string(" (%d encounters)", "encounter_count")
    )
    pages = _pages(rows.withColumn("all", F.lit(1)), ["all"], "concept", entry, "listed", page_size)
    one = lambda df, c: df.select(c).scalar()
    head = F.concat(
        F.lit(f"---\ntags:\n  - {tag}/index\nupdated: {today}\n"),
        F.format_string("total_nodes: %d\ntotal_edges: %d\n---\n\n# Knowledge Graph\n\n", "n", "m"),
        F.format_string("**%d concepts** · **%d connections**\n\n", "n", "m"),
        F.lit("## Concepts by Domain\n\n| Domain | Concepts | Top Concept |\n"),
        F.lit("|--------|----------|-------------|\n"), "domains",
        F.lit("\n\n## Top Concepts by Familiarity\n\n"),
        F.lit("| Concept | Familiarity | Encounters | Connections |\n"),
        F.lit("|---------|------------|------------|-------------|\n"), "fams",
        F.lit("\n\n## Top Concepts by Connections\n\n| Concept | Connections | Familiarity |\n"),
        F.lit("|---------|------------|------------|\n"), "degs", F.lit("\n\n## All Concepts\n\n"),
    )
    return pages.withColumns(
        {
            "n": nodes.agg(F.count(F.lit(1))).scalar(),
            "m": edge_count(ends),
            "domains": one(per_domain, "t"),
            "fams": one(top_fam, "t"),
            "degs": one(top_deg, "t"),
        }
    ).select(
        _page_path(F.lit("Knowledge Graph")).alias("path"),
        "page",
        F.concat(
            F.when(F.col("page") == 0, head).otherwise(F.lit("")), "listed", F.lit("\n")
        ).alias("content"),
    )
