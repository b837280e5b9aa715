"""XML and JSON payloads, landed as text, parsed into article entries.

Every parser takes ``landed(source_name, base_url, max_articles, feed_pos, payload)`` with one
fetched document per row and works row by row: no shuffle, and a source with many payloads is as
parallel as its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.text import (
    blank_to_null,
    let,
    one_per_key,
    post_title,
    strip,
    strip_tags,
    toot_title,
)
from newsweft.operators.skew import top_per_group

XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_ITEM = (
    "array<struct<title string, link string, description string, enclosure struct<_url string>>>"
)
_RSS = f"channel struct<item {_ITEM}>, item {_ITEM}"
_ENTRY = (
    "array<struct<title string, id string, summary string, "
    "link array<struct<_href string, _rel string>>, "
    "`group` struct<description string>>>"
)
_ATOM = f"entry {_ENTRY}"

# Item pages and address forms of the services the payloads come from.
STORY_PAGE = "https://news.ycombinator.com/item?id="
LISTING_HOST = "https://www.reddit.com"
PAPER_PAGE = "https://huggingface.co/papers/"
REPOSITORY_HOST = "https://github.com"
POST_INTERNAL_HOSTS = ("bsky.app", "bsky.social")
LINK_FACET = "app.bsky.richtext.facet#link"
EXTERNAL_EMBED = "app.bsky.embed.external#view"
# What counts as an address in plain and in marked-up text.
PLAIN_URL = r"https?://[^\s<>\"')\]]+"
HREF = r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""


def entry(title: Column, url: Column, snippet: Column, score: Column | None = None) -> Column:
    return F.struct(
        title.alias("title"),
        url.alias("url"),
        snippet.cast("string").alias("snippet"),
        (F.lit(None) if score is None else score).cast("int").alias("score"),
    )


def emit(df: DataFrame, items: Column) -> DataFrame:
    """One output row per array element."""
    return df.select("source_name", "feed_pos", F.posexplode(items).alias("item_pos", "e")).select(
        F.col("e.title").alias("title"),
        F.col("e.url").alias("url"),
        "source_name",
        F.col("e.snippet").alias("snippet"),
        F.col("e.score").alias("score"),
        "feed_pos",
        F.col("item_pos").cast("long").alias("item_pos"),
    )


def head(items: Column) -> Column:
    return F.slice(items, 1, F.col("max_articles"))


def complete(items: Column) -> Column:
    return F.filter(items, lambda e: (e["title"] != "") & (e["url"] != ""))


def text_of(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def cut(c: Column, n: int) -> Column:
    """First ``n`` characters, NULL when there is no text."""
    return F.substring(blank_to_null(c), 1, n)


def keep_first_url(items: Column) -> Column:
    """Drop later elements that repeat an earlier element's url."""
    return let(items, lambda every: one_per_key(every, lambda e: e["url"]))


def _rss(payload: Column) -> Column:
    doc = F.from_xml(payload, _RSS, XML)
    none = F.array().cast(_ITEM)
    return let(
        doc, lambda d: F.concat(F.coalesce(d["channel"]["item"], none), F.coalesce(d["item"], none))
    )


def _rss_entries(payload: Column, snippet_len: int) -> Column:
    return F.transform(
        head(_rss(payload)),
        lambda i: entry(
            text_of(i["title"]), text_of(i["link"]), cut(text_of(i["description"]), snippet_len)
        ),
    )


def rss_items(df: DataFrame, snippet_len: int = 400) -> DataFrame:
    """RSS items with a title and a link; the source's limit counts before that check."""
    return emit(df, complete(_rss_entries(F.col("payload"), snippet_len)))


def podcast_items(df: DataFrame) -> DataFrame:
    """Episodes; a missing link falls back to the enclosure."""

    def one(i: Column) -> Column:
        link = F.coalesce(
            blank_to_null(text_of(i["link"])), i["enclosure"]["_url"], F.lit("")
        )
        notes = text_of(i["description"])
        snippet = F.when(notes != "", F.substring(strip(strip_tags(notes)), 1, 500))
        return entry(text_of(i["title"]), link, snippet)

    return emit(df, complete(F.transform(head(_rss(F.col("payload"))), one)))


def _entries(payload: Column) -> Column:
    return F.coalesce(F.from_xml(payload, _ATOM, XML)["entry"], F.array().cast(_ENTRY))


def _entry_link(e: Column) -> Column:
    alternate = F.filter(e["link"], lambda x: x["_rel"] == "alternate")
    return F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"], F.lit(""))


def _atom_entries(payload: Column) -> Column:
    return F.transform(
        head(_entries(payload)),
        lambda e: entry(
            text_of(e["title"]), strip(_entry_link(e)), F.substring(strip(e["summary"]), 1, 400)
        ),
    )


def atom_entries(df: DataFrame) -> DataFrame:
    return emit(df, complete(_atom_entries(F.col("payload"))))


def feed_entries(df: DataFrame, snippet_len: int = 400) -> DataFrame:
    """Either dialect: RSS items when there are any, else Atom entries."""
    payload = F.col("payload")
    both = F.struct(
        _rss_entries(payload, snippet_len).alias("rss"), _atom_entries(payload).alias("atom")
    )
    return emit(
        df,
        complete(let(both, lambda b: F.when(F.size(b["rss"]) > 0, b["rss"]).otherwise(b["atom"]))),
    )


def paper_entries(df: DataFrame) -> DataFrame:
    """Preprints: the entry id is the address, abstract pages upgraded to https."""

    def one(e: Column) -> Column:
        url = F.regexp_replace(text_of(e["id"]), "^http://(arxiv\\.org/abs/)", "https://$1")
        title = F.translate(text_of(e["title"]), "\n", " ")
        return entry(title, url, F.substring(strip(e["summary"]), 1, 500))

    return emit(df, complete(F.transform(head(_entries(F.col("payload"))), one)))


def video_entries(df: DataFrame) -> DataFrame:
    def one(e: Column) -> Column:
        about = text_of(e["group"]["description"])
        snippet = F.when(about != "", F.substring(strip(strip_tags(about)), 1, 500))
        return entry(text_of(e["title"]), _entry_link(e), snippet)

    return emit(df, complete(F.transform(head(_entries(F.col("payload"))), one)))


def story_items(df: DataFrame) -> DataFrame:
    """One JSON item per payload; stories without an address link to their own page."""
    item = F.from_json(
        "payload", "id bigint, type string, title string, url string, text string, score int"
    )
    return (
        df.withColumn("i", item)
        .filter(F.col("i.type") == "story")
        .select(
            F.coalesce("i.title", F.lit("")).alias("title"),
            F.coalesce(
                blank_to_null(F.col("i.url")), F.concat(F.lit(STORY_PAGE), F.col("i.id"))
            ).alias("url"),
            "source_name",
            F.col("i.text").alias("snippet"),
            F.col("i.score").alias("score"),
            "feed_pos",
            F.lit(0).cast("long").alias("item_pos"),
        )
    )


def listing_posts(df: DataFrame) -> DataFrame:
    """Posts of a paged listing; the source's limit counts usable posts over all its pages."""
    schema = (
        "data struct<children array<struct<data struct<title string, url string, is_self boolean, "
        "permalink string, selftext string, score int, stickied boolean>>>>"
    )
    posts = F.filter(
        F.transform(F.from_json("payload", schema)["data"]["children"], lambda c: c["data"]),
        lambda p: ~F.coalesce(p["stickied"], F.lit(False))
        & (F.coalesce(p["url"], F.lit("")) != "")
        & (F.coalesce(p["title"], F.lit("")) != ""),
    )
    items = F.transform(
        posts,
        lambda p: entry(
            p["title"],
            F.when(
                F.coalesce(p["is_self"], F.lit(False)),
                F.concat(F.lit(LISTING_HOST), F.coalesce(p["permalink"], F.lit(""))),
            ).otherwise(p["url"]),
            cut(p["selftext"], 300),
            p["score"],
        ),
    )
    limits = df.select("source_name", "feed_pos", "max_articles")
    rows = emit(df, head(items)).join(limits, ["source_name", "feed_pos"])
    ranked = top_per_group(
        rows, ["source_name"], [F.col("feed_pos"), F.col("item_pos")], F.col("max_articles")
    )
    return ranked.drop("max_articles")


def hot_stories(df: DataFrame) -> DataFrame:
    schema = (
        "array<struct<title string, url string, comments_url string, description string, score int>>"
    )
    items = F.transform(
        head(F.from_json("payload", schema)),
        lambda s: entry(
            F.coalesce(s["title"], F.lit("")),
            F.coalesce(blank_to_null(s["url"]), s["comments_url"], F.lit("")),
            cut(s["description"], 400),
            s["score"],
        ),
    )
    return emit(df, complete(items))


def daily_papers(df: DataFrame) -> DataFrame:
    schema = "array<struct<paper struct<title string, id string, summary string>, numUpvotes int>>"

    def one(p: Column) -> Column:
        key = F.coalesce(p["paper"]["id"], F.lit(""))
        url = F.when(key != "", F.concat(F.lit(PAPER_PAGE), key)).otherwise("")
        return entry(
            text_of(p["paper"]["title"]), url, cut(p["paper"]["summary"], 400), p["numUpvotes"]
        )

    return emit(df, complete(F.transform(head(F.from_json("payload", schema)), one)))


def post_links(df: DataFrame) -> DataFrame:
    """One article per post: its first external link no earlier post of the payload has used.

    Payloads list posts as ``posts`` (search) or as ``feed[].post`` (timeline)."""
    post = (
        "struct<record struct<text string, "
        "facets array<struct<features array<struct<`$type` string, uri string>>>>>, "
        "embed struct<`$type` string, external struct<uri string>>>"
    )
    schema = f"posts array<{post}>, feed array<struct<post {post}>>"
    none = F.array().cast("array<string>")

    def links(p: Column) -> Column:
        written = F.regexp_extract_all(p["record"]["text"], F.lit(PLAIN_URL), F.lit(0))
        features = F.flatten(F.transform(p["record"]["facets"], lambda f: f["features"]))
        tagged = F.transform(
            F.filter(features, lambda x: x["$type"] == LINK_FACET), lambda x: x["uri"]
        )
        embedded = F.when(
            p["embed"]["$type"] == EXTERNAL_EMBED, F.array(p["embed"]["external"]["uri"])
        )
        every = F.concat(*[F.coalesce(x, none) for x in (written, tagged, embedded)])
        internal = "|".join(h.replace(".", r"\.") for h in POST_INTERNAL_HOSTS)
        return F.filter(every, lambda u: (u != "") & ~u.rlike(internal))

    posts = let(
        F.from_json("payload", schema),
        lambda j: F.transform(
            F.coalesce(j["posts"], F.transform(j["feed"], lambda x: x["post"])),
            lambda p: F.struct(
                F.coalesce(p["record"]["text"], F.lit("")).alias("text"), links(p).alias("links")
            ),
        ),
    )
    start = F.struct(
        none.alias("used"), F.array().cast("array<struct<text:string,url:string>>").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        def take(free: Column) -> Column:
            hit = F.struct(p["text"].alias("text"), free[0].alias("url"))
            found = F.struct(
                F.concat(acc["used"], F.array(free[0])).alias("used"),
                F.concat(acc["out"], F.array(hit)).alias("out"),
            )
            return F.when(F.size(free) > 0, found).otherwise(acc)

        free = F.filter(p["links"], lambda u: ~F.array_contains(acc["used"], u))
        return F.when(F.size(acc["out"]) >= F.col("max_articles"), acc).otherwise(let(free, take))

    chosen = F.aggregate(posts, start, step)["out"]
    items = F.transform(
        chosen, lambda o: entry(post_title(o["text"]), o["url"], cut(o["text"], 400))
    )
    return emit(df, items)


def toot_links(df: DataFrame) -> DataFrame:
    """Preview card first, else the first link that leaves the instance in ``base_url``."""
    schema = (
        "array<struct<content string, card struct<url string, title string, description string>>>"
    )
    instance = F.regexp_replace(F.coalesce("base_url", F.lit("")), r"/+\z", "")

    def one(t: Column) -> Column:
        content = F.coalesce(t["content"], F.lit(""))
        return let(
            F.struct(
                t["card"].alias("card"),
                strip(strip_tags(content)).alias("plain"),
                F.regexp_extract_all(content, F.lit(HREF), F.lit(1)).alias("hrefs"),
            ),
            pick,
        )

    def pick(t: Column) -> Column:
        card, plain, hrefs = t["card"], t["plain"], t["hrefs"]
        urls = F.when(F.size(hrefs) > 0, hrefs).otherwise(
            F.regexp_extract_all(plain, F.lit(PLAIN_URL), F.lit(0))
        )
        external = F.filter(urls, lambda u: ~u.startswith(instance))
        carded = F.coalesce(card["url"] != "", F.lit(False))
        title = F.when(carded, F.coalesce(blank_to_null(card["title"]), F.substring(plain, 1, 120)))
        about = F.when(
            carded, F.coalesce(blank_to_null(card["description"]), F.substring(plain, 1, 400))
        )
        return entry(
            toot_title(F.coalesce(title, F.substring(plain, 1, 120))),
            F.when(carded, card["url"]).otherwise(F.get(external, F.lit(0))),
            blank_to_null(F.coalesce(about, F.substring(plain, 1, 400))),
        )

    items = F.filter(
        F.transform(F.from_json("payload", schema), one), lambda e: e["url"].isNotNull()
    )
    return emit(df, head(keep_first_url(items)))
