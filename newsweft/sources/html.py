"""HTML and OPML payloads, plus the choice between feed and page parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.text import WS, let, strip, strip_tags
from newsweft.functions.urls import resolve_url
from newsweft.sources.feeds import (
    REPOSITORY_HOST,
    emit,
    entry,
    feed_entries,
    head,
    keep_first_url,
)

# Where the payloads keep links, and how the repository page marks its rows.
_ANCHOR = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
_ROW = r'(?is)<article\s[^>]*class="[^"]*Box-row[^"]*"[^>]*>(.*?)</article>'
_ROW_LINK = r'(?is)<h2[^>]*>\s*<a\s[^>]*href="(/[^"]+)"[^>]*>'
_ROW_TEXT = r'(?is)<p\s[^>]*class="[^"]*col-9[^"]*"[^>]*>(.*?)</p>'
_ROW_STARS = r"(?i)(\d[\d,]*)\s*stars\s+today"
# The predefined XML entities, the ampersand last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def is_feed(content_type: Column, payload: Column) -> Column:
    opening = F.substring(F.regexp_replace(payload, rf"^[{WS}]+", ""), 1, 200)
    declared = F.coalesce(content_type.rlike("xml|rss|atom"), F.lit(False))
    return declared | opening.rlike(r"^(<\?xml|<rss|<feed)")


def detect_feed(df: DataFrame) -> DataFrame:
    kind = F.when(is_feed(F.col("content_type"), F.col("payload")), "feed").otherwise("html")
    return df.withColumn("kind", kind)


def html_links(df: DataFrame) -> DataFrame:
    """Anchors with a headline-sized text; one row per address and page, in page order."""

    def anchors(page: Column) -> Column:
        both = F.arrays_zip(
            F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(1)).alias("href"),
            F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(2)).alias("inner"),
        )
        trimmed = F.transform(
            both,
            lambda a: F.struct(
                strip(a["href"]).alias("href"), strip(strip_tags(a["inner"])).alias("text")
            ),
        )
        good = F.filter(
            trimmed,
            lambda a: F.length(a["text"]).between(10, 300)
            & ~a["href"].startswith("#")
            & ~a["href"].startswith("javascript:"),
        )
        return F.transform(
            good, lambda a: entry(a["text"], resolve_url(F.col("base_url"), a["href"]), F.lit(None))
        )

    return emit(df, head(keep_first_url(anchors(F.col("payload")))))


def generic_entries(df: DataFrame) -> DataFrame:
    """Feeds and pages in one input, each row parsed by what it looks like."""
    sorted_ = detect_feed(df)
    feeds = feed_entries(sorted_.filter(F.col("kind") == "feed"))
    pages = html_links(sorted_.filter(F.col("kind") == "html"))
    return feeds.unionByName(pages)


def trending_repos(df: DataFrame) -> DataFrame:
    def one(row: Column) -> Column:
        path = strip(F.regexp_extract(row, _ROW_LINK, 1))
        text = F.when(
            row.rlike(_ROW_TEXT),
            F.substring(strip(strip_tags(F.regexp_extract(row, _ROW_TEXT, 1))), 1, 400),
        )
        stars = F.translate(F.regexp_extract(row, _ROW_STARS, 1), ",", "").try_cast("int")
        return entry(
            F.ltrim(path, F.lit("/")), F.concat(F.lit(REPOSITORY_HOST), path), text, stars
        )

    rows = F.filter(
        F.regexp_extract_all("payload", F.lit(_ROW), F.lit(1)), lambda r: r.rlike(_ROW_LINK)
    )
    return emit(df, F.transform(head(rows), one))


def _attribute(tag: Column, name: str) -> Column:
    value = F.coalesce(
        F.nullif(F.regexp_extract(tag, rf'(?s)\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?s)\s{name}\s*=\s*'([^']*)'", 1), F.lit("")),
    )
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def opml_feeds(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed outlines of any depth, marked ``added`` or ``skipped``.

    An address is skipped when ``sources`` has it or an earlier outline named it.
    """
    tags = F.regexp_extract_all("payload", F.lit(r"""(?s)<outline(\s(?:[^>"']|"[^"]*"|'[^']*')*)>"""), F.lit(1))
    outlines = (
        df.select("feed_pos", F.posexplode(tags).alias("item_pos", "tag"))
        .select(
            "feed_pos",
            F.col("item_pos").cast("long").alias("item_pos"),
            _attribute(F.col("tag"), "xmlUrl").alias("url"),
            _attribute(F.col("tag"), "text").alias("text"),
            _attribute(F.col("tag"), "title").alias("title"),
        )
        .filter(F.col("url").isNotNull())
        .select(
            "feed_pos", "item_pos", "url", F.coalesce("text", "title", "url").alias("name")
        )
    )
    firsts = outlines.groupBy("url").agg(F.min(F.struct("feed_pos", "item_pos")).alias("first"))
    known = sources.select("url").filter("url is not null").distinct().withColumn("known", F.lit(True))
    return (
        outlines.join(firsts, "url")
        .join(known, "url", "left")
        .select(
            "name",
            "url",
            F.when(
                F.col("known").isNull() & (F.struct("feed_pos", "item_pos") == F.col("first")), "added"
            )
            .otherwise("skipped")
            .alias("status"),
            "feed_pos",
            "item_pos",
        )
    )
