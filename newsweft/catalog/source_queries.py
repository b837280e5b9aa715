"""Payload parsers: documents are written out as payloads and parsed back."""

from pyspark.sql import functions as F

from newsweft.catalog.core import VIEW_SQL, day_text, query, sql_strip, sql_strip_tags
from newsweft.lineage import Scratch
from newsweft.operators.documents import apart, write_documents
from newsweft.sources import feeds, files, html, registry

VIEW_SQL["line"] = (
    "SELECT doc_id, source, lang, CAST(i-1 AS BIGINT) AS i, l[i] AS line FROM "
    "(SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents) d, "
    "unnest(range(1, len(l)+1)) AS t(i)"
)
LIMIT = 100_000  # lies above the longest document; S1_limited tests the limit itself


def escaped(c):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def landed(t, payload, limit=LIMIT):
    """One payload per document, built from all its lines ``l``."""
    docs = t.documents.withColumn("l", F.split("text", "\n"))
    return docs.select(
        F.col("source").alias("source_name"),
        F.lit("http://base.example/dir/page").alias("base_url"),
        F.lit(limit).alias("max_articles"),
        F.col("doc_id").alias("feed_pos"),
        payload.alias("payload"),
        F.lit("").alias("content_type"),
    )


def each_line(fn):
    return F.array_join(F.transform(F.col("l"), fn), "")


def address(i, kind="x"):
    return F.concat(F.lit(f"http://{kind}/"), F.col("doc_id"), F.lit("/"), i)


def tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def rss_payload(link=True):
    def item(x, i):
        url = F.when(i % 2 == 0, address(i)).otherwise("") if not link else address(i)
        return tag(
            "item",
            F.concat(
                tag("title", escaped(F.substring(x, 1, 80))),
                tag("link", url),
                tag("description", escaped(F.concat(F.lit("<p>"), x, F.lit("</p>")))),
                F.lit('<enclosure url="http://enc/'), i, F.lit('"/>'),
            ),
        )

    return F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0">'), tag("channel", each_line(item)), F.lit("</rss>")
    )


def atom_payload():
    def one(x, i):
        return tag(
            "entry",
            F.concat(
                tag("title", escaped(F.substring(x, 1, 80))),
                tag("id", F.concat(F.lit("http://arxiv.org/abs/"), F.col("doc_id"), F.lit("."), i)),
                F.lit('<link rel="self" href="'), address(i, "self"),
                F.when(i % 2 == 0, F.concat(F.lit('"/><link rel="alternate" href="'), address(i, "alt")))
                .otherwise(""),
                F.lit('"/>'),
                tag("summary", escaped(x)),
                tag(
                    "media:group",
                    tag("media:description", escaped(F.concat(F.lit("<i>"), x, F.lit("</i>")))),
                ),
            ),
        )

    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">'
    return F.concat(F.lit(head), each_line(one), F.lit("</feed>"))


def shown(df, *extra):
    return df.select(
        "url", F.md5("title").alias("title"), F.md5("snippet").alias("snippet"), *extra
    )


_TITLE = sql_strip("substring(line,1,80)")
_TEXT = sql_strip("line")
_HEAD = f"FROM line WHERE i < {LIMIT} AND {_TITLE} <> ''"


@query(
    "S1_rss_items",
    f"SELECT 'http://x/'||doc_id||'/'||i AS url, md5({_TITLE}) AS title, "
    f"md5(substring('<p>'||line||'</p>',1,400)) AS snippet {_HEAD}",
    ["line"],
)
def s1(t):
    return shown(feeds.rss_items(landed(t, rss_payload())))


@query(
    "S1_limited",
    f"SELECT 'http://x/'||doc_id||'/'||i AS url, md5({_TITLE}) AS title, "
    f"md5(substring('<p>'||line||'</p>',1,400)) AS snippet FROM line WHERE i < 7 AND {_TITLE} <> ''",
    ["line"],
)
def s1_limited(t):
    return shown(feeds.rss_items(landed(t, rss_payload(), limit=7)))


@query(
    "S2_podcast_items",
    f"SELECT CASE WHEN i%2=0 THEN 'http://x/'||doc_id||'/'||i ELSE 'http://enc/'||i END AS url, "
    f"md5({_TITLE}) AS title, md5(substring({sql_strip(sql_strip_tags('line'))},1,500)) AS snippet {_HEAD}",
    ["line"],
)
def s2(t):
    return shown(feeds.podcast_items(landed(t, rss_payload(link=False))))


@query(
    "S3_atom_entries",
    "SELECT CASE WHEN i%2=0 THEN 'http://alt/' ELSE 'http://self/' END||doc_id||'/'||i AS url, "
    f"md5({_TITLE}) AS title, md5(substring({_TEXT},1,400)) AS snippet {_HEAD}",
    ["line"],
)
def s3(t):
    return shown(feeds.atom_entries(landed(t, atom_payload())))


@query(
    "S4_paper_entries",
    "SELECT 'https://arxiv.org/abs/'||doc_id||'.'||i AS url, "
    f"md5({_TITLE}) AS title, md5(substring({_TEXT},1,500)) AS snippet {_HEAD}",
    ["line"],
)
def s4(t):
    return shown(feeds.paper_entries(landed(t, atom_payload())))


@query(
    "S5_video_entries",
    "SELECT CASE WHEN i%2=0 THEN 'http://alt/' ELSE 'http://self/' END||doc_id||'/'||i AS url, "
    f"md5({_TITLE}) AS title, md5(substring({sql_strip(sql_strip_tags('line'))},1,500)) AS snippet {_HEAD}",
    ["line"],
)
def s5(t):
    return shown(feeds.video_entries(landed(t, atom_payload())))


@query(
    "S6_detect_feed",
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id%3=0 THEN 'html' ELSE 'feed' END AS kind "
    "FROM documents UNION ALL SELECT 'html' FROM pages) GROUP BY 1",
)
def s6(t):
    d = F.col("doc_id")
    mixed = (
        F.when(d % 3 == 0, F.concat(F.lit("<p>"), "text"))
        .when(d % 3 == 1, F.concat(F.lit("\n <rss>"), "text"))
        .otherwise(F.concat(F.lit("  <feed>"), "text"))
    )
    pages = t.pages.select(
        F.col("html").alias("payload"), F.lit("text/html").alias("content_type")
    )
    both = landed(t, mixed).select("payload", "content_type").unionByName(pages)
    return html.detect_feed(both).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def page_payloads(t):
    # link texts are lengthened past the headline minimum
    return t.pages.select(
        F.lit("pages").alias("source_name"),
        F.col("url").alias("base_url"),
        F.lit(4).alias("max_articles"),
        F.col("page_id").alias("feed_pos"),
        F.regexp_replace("html", "</a>", " and more</a>").alias("payload"),
        F.lit("text/html").alias("content_type"),
    )


_SQL_LINKS = (
    r"a AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS host, "
    r"regexp_extract_all(html, '(?is)<a\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 1) AS h, "
    r"regexp_extract_all(html, '(?is)<a\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 2) AS x FROM pages), "
    "b AS (SELECT page_id, host||h[i] AS url, " + sql_strip(sql_strip_tags("x[i]||' and more'")) + " AS title, i "
    "FROM a, unnest(range(1, len(h)+1)) AS t(i)), "
    "c AS (SELECT * FROM b WHERE length(title) BETWEEN 10 AND 300 "
    "QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1), "
    "links AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 4)"
)


@query("S7_html_links", f"WITH {_SQL_LINKS} SELECT page_id, url, title FROM links")
def s7(t):
    return html.html_links(page_payloads(t)).select(
        F.col("feed_pos").alias("page_id"), "url", "title"
    )


@query(
    "S6_S7_generic_entries",
    f", {_SQL_LINKS} SELECT url, md5(title) AS title FROM links UNION ALL "
    f"SELECT 'http://x/'||doc_id||'/'||i AS url, md5({_TITLE}) AS title {_HEAD}",
    ["line"],
)
def s67(t):
    both = page_payloads(t).unionByName(landed(t, rss_payload()))
    return html.generic_entries(both).select("url", F.md5("title").alias("title"))


@query(
    "S8_story_items",
    "SELECT 't'||event_id AS title, CASE WHEN k%3=0 THEN 'https://news.ycombinator.com/item?id='||event_id "
    "ELSE 'http://s/'||event_id END AS url, CASE WHEN k%2=0 THEN props END AS snippet, k AS score "
    "FROM ev WHERE event_type='view'",
    ["ev"],
)
def s8(t):
    k = F.col("k")
    item = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.when(F.col("event_type") == "view", "story").otherwise("comment").alias("type"),
            F.concat(F.lit("t"), "event_id").alias("title"),
            F.when(k % 3 > 0, F.concat(F.lit("http://s/"), "event_id")).alias("url"),
            F.when(k % 2 == 0, F.col("props")).alias("text"),
            k.alias("score"),
        )
    )
    rows = t.events.select(
        F.lit("stories").alias("source_name"), F.col("event_id").alias("feed_pos"), item.alias("payload")
    )
    return feeds.story_items(rows).select("title", "url", "snippet", "score")


def json_lines(fn):
    return F.transform(F.col("l"), fn)


@query(
    "S9_listing_posts",
    ", p AS (SELECT l.*, s.max_articles FROM line l JOIN sources s ON s.name = l.source "
    "WHERE i%5<>0 AND line <> ''), r AS (SELECT * FROM p "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, i) <= max_articles) "
    "SELECT source AS source_name, CASE WHEN i%3=0 THEN 'https://www.reddit.com/r/'||i ELSE "
    "'http://x/'||doc_id||'/'||i END AS url, md5(line) AS title, md5(substring(line,1,300)) AS snippet, "
    "CAST(i AS INTEGER) AS score FROM r",
    ["line", "sources"],
)
def s9(t):
    post = lambda x, i: F.struct(
        F.struct(
            x.alias("title"), address(i).alias("url"), (i % 3 == 0).alias("is_self"),
            F.concat(F.lit("/r/"), i).alias("permalink"), x.alias("selftext"), i.alias("score"),
            (i % 5 == 0).alias("stickied"),
        ).alias("data")
    )
    payload = F.to_json(F.struct(F.struct(json_lines(post).alias("children")).alias("data")))
    limits = t.sources.withColumnRenamed("name", "source_name")
    rows = landed(t, payload).drop("max_articles").join(limits, "source_name")
    return shown(feeds.listing_posts(rows), "source_name", "score")


@query(
    "S10_hot_stories",
    "SELECT CASE WHEN i%2=0 THEN 'http://x/'||doc_id||'/'||i ELSE 'http://c/'||doc_id||'/'||i END AS url, "
    "md5(line) AS title, md5(substring(line,1,400)) AS snippet, CAST(i AS INTEGER) AS score "
    f"FROM line WHERE i < {LIMIT} AND line <> ''",
    ["line"],
)
def s10(t):
    story = lambda x, i: F.struct(
        x.alias("title"),
        F.when(i % 2 == 0, address(i)).otherwise("").alias("url"),
        address(i, "c").alias("comments_url"), x.alias("description"), i.alias("score"),
    )
    return shown(feeds.hot_stories(landed(t, F.to_json(json_lines(story)))), "score")


@query(
    "S11_daily_papers",
    f"SELECT 'https://huggingface.co/papers/'||doc_id||'.'||i AS url, md5({_TEXT}) AS title, "
    "md5(substring(line,1,400)) AS snippet, CAST(i AS INTEGER) AS score "
    f"FROM line WHERE i < {LIMIT} AND {_TEXT} <> ''",
    ["line"],
)
def s11(t):
    paper = lambda x, i: F.struct(
        F.struct(
            x.alias("title"), F.concat("doc_id", F.lit("."), i).alias("id"), x.alias("summary")
        ).alias("paper"),
        i.alias("numUpvotes"),
    )
    return shown(feeds.daily_papers(landed(t, F.to_json(json_lines(paper)))), "score")


@query(
    "S12_post_links",
    ", p AS (SELECT doc_id, list({'used': []::VARCHAR[], 'out': []::STRUCT(i BIGINT, url VARCHAR)[], "
    "'links': ['http://l/'||((i*7)%5), 'http://f/'||((i*3)%6), 'http://e/'||(i%9)], 'i': i} ORDER BY i) AS ps "
    "FROM line GROUP BY doc_id), f AS (SELECT doc_id, list_reduce(list_prepend({'used': []::VARCHAR[], "
    "'out': []::STRUCT(i BIGINT, url VARCHAR)[], 'links': []::VARCHAR[], 'i': -1::BIGINT}, ps), lambda a, p: "
    f"CASE WHEN len(a.out) >= {LIMIT} OR len(list_filter(p.links, lambda u: NOT list_contains(a.used, u))) = 0 THEN a "
    "ELSE {'used': list_append(a.used, list_filter(p.links, lambda u: NOT list_contains(a.used, u))[1]), "
    "'out': list_append(a.out, {'i': p.i, 'url': list_filter(p.links, lambda u: NOT list_contains(a.used, u))[1]}), "
    "'links': p.links, 'i': p.i} END).out AS out FROM p), "
    "o AS (SELECT doc_id, unnest(out) AS o FROM f), j AS (SELECT o.doc_id, o.o.url AS url, "
    "'see http://l/'||((o.o.i*7)%5)||' and http://bsky.app/x '||l.line AS txt FROM o JOIN line l "
    "ON l.doc_id=o.doc_id AND l.i=o.o.i) "
    "SELECT url, md5(" + sql_strip("substring(txt,1,120)") + "||CASE WHEN length(txt)>120 THEN '...' ELSE '' END) AS title, "
    "md5(substring(txt,1,400)) AS snippet FROM j",
    ["line"],
)
def s12(t):
    def post(x, i):
        words = F.concat(F.lit("see http://l/"), (i * 7) % 5, F.lit(" and http://bsky.app/x "), x)
        facet = F.struct(
            F.array(
                F.struct(
                    F.lit(feeds.LINK_FACET).alias("$type"),
                    F.concat(F.lit("http://f/"), (i * 3) % 6).alias("uri"),
                )
            ).alias("features")
        )
        embed = F.struct(
            F.lit(feeds.EXTERNAL_EMBED).alias("$type"),
            F.struct(F.concat(F.lit("http://e/"), i % 9).alias("uri")).alias("external"),
        )
        record = F.struct(words.alias("text"), F.array(facet).alias("facets"))
        return F.struct(record.alias("record"), embed.alias("embed"))

    listed = F.to_json(F.struct(json_lines(post).alias("posts")))
    timeline = F.to_json(F.struct(json_lines(lambda x, i: F.struct(post(x, i).alias("post"))).alias("feed")))
    payload = F.when(F.col("doc_id") % 3 == 0, timeline).otherwise(listed)
    # the words of a document hold no links of their own
    return shown(feeds.post_links(landed(t, payload)))


_TOOT = "CASE WHEN length(x)>120 THEN substring(x,1,117)||'...' ELSE x END"


@query(
    "S13_toot_links",
    ", a AS (SELECT doc_id, i, CASE WHEN i%2=0 THEN 'http://card/'||(i%8) ELSE 'http://out/'||(i%5) END AS url, "
    "CASE WHEN i%2=0 THEN 'card '||line ELSE substring("
    + sql_strip(sql_strip_tags("line||'x'||'y'"))
    + ",1,120) END AS x, "
    "CASE WHEN i%2=0 THEN 'd'||i ELSE substring(" + sql_strip(sql_strip_tags("line||'x'||'y'")) + ",1,400) END AS snippet FROM line), "
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, url ORDER BY i)=1), "
    f"c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {LIMIT}) "
    f"SELECT url, md5({_TOOT}) AS title, md5(snippet) AS snippet FROM c",
    ["line"],
)
def s13(t):
    def toot(x, i):
        content = F.concat(
            x, F.lit('<a class="m" href="http://base.example/dir/page/t">x</a>'),
            F.lit('<a class="m" href="http://out/'), i % 5, F.lit('">y</a>'),
        )
        card = F.when(
            i % 2 == 0,
            F.struct(
                F.concat(F.lit("http://card/"), i % 8).alias("url"),
                F.concat(F.lit("card "), x).alias("title"),
                F.concat(F.lit("d"), i).alias("description"),
            ),
        )
        return F.struct(content.alias("content"), card.alias("card"))

    return shown(feeds.toot_links(landed(t, F.to_json(json_lines(toot)))))


@query(
    "S14_trending_repos",
    "SELECT 'o'||doc_id||'/r'||i AS title, 'https://github.com/o'||doc_id||'/r'||i AS url, "
    f"md5(substring({sql_strip(sql_strip_tags('line'))},1,400)) AS snippet, CAST(1000+i AS INTEGER) AS score "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM line WHERE i%4<>3) WHERE r <= {LIMIT}",
    ["line"],
)
def s14(t):
    def row(x, i):
        head = F.when(i % 4 == 3, "<h2>none</h2>").otherwise(
            F.concat(F.lit('<h2 class="h3"> <a data-x href="/o'), "doc_id", F.lit("/r"), i, F.lit('"></a></h2>'))
        )
        return F.concat(
            F.lit('<article class="Box-row">'), head, F.lit('<p class="col-9 my-1">'), x,
            F.lit("</p> "), F.format_number((i + 1000).cast("int"), 0), F.lit(" stars today</article>"),
        )

    repos = html.trending_repos(landed(t, each_line(row)))
    return repos.select("title", "url", F.md5("snippet").alias("snippet"), "score")


@query(
    "S15_opml_feeds",
    ", o AS (SELECT doc_id, i, 'http://feed/'||((doc_id*31+i)%997)||'?a&b' AS url, "
    "CASE WHEN i%3=0 THEN 'T&'||i WHEN i%3=1 THEN 'L'||i END AS nm FROM line), "
    "k AS (SELECT DISTINCT 'http://feed/'||(doc_id%997)||'?a&b' AS url FROM labels WHERE toxic=1) "
    "SELECT coalesce(nm, url) AS name, url, CASE WHEN url IN (SELECT url FROM k) OR "
    "row_number() OVER (PARTITION BY url ORDER BY doc_id, i) > 1 THEN 'skipped' ELSE 'added' END AS status FROM o",
    ["line"],
)
def s15(t):
    def outline(x, i):
        name = (
            F.when(i % 3 == 0, F.concat(F.lit(' text="T&amp;'), i, F.lit('"')))
            .when(i % 3 == 1, F.concat(F.lit(" title='L"), i, F.lit("'")))
            .otherwise("")
        )
        return F.concat(
            F.lit("<outline"), name, F.lit(' xmlUrl="http://feed/'),
            (F.col("doc_id") * 31 + i) % 997, F.lit('?a&amp;b"/>'),
        )

    payload = F.concat(
        F.lit('<opml><body><outline text="folder">'), each_line(outline), F.lit("</outline></body></opml>")
    )
    known = t.read("labels").filter("toxic = 1").select(
        F.concat(F.lit("http://feed/"), F.col("doc_id") % 997, F.lit("?a&b")).alias("url")
    )
    return html.opml_feeds(landed(t, payload), known).select("name", "url", "status")


@query(
    "S16_W14_briefing_files",
    "SELECT CAST(DATE '1990-01-01' + CAST(doc_id AS INTEGER) AS VARCHAR) AS briefing_date, md5(text) AS md FROM documents",
)
def s16(t):
    root = Scratch(t.spark, "briefings").root
    docs = t.documents.select(
        F.date_add(F.lit("1990-01-01").cast("date"), F.col("doc_id").cast("int")).alias("briefing_date"),
        F.col("text").alias("md"),
    )
    name = F.coalesce(F.col("briefing_date").cast("string"), F.lit("undated"))
    rows = docs.filter("md IS NOT NULL").select(F.concat(name, F.lit(".md")).alias("path"), F.col("md").alias("content"))
    write_documents(apart(rows), root)
    # a file cannot tell a missing text from an empty one, so what has none is no file
    out = files.read_briefings(t.spark, root, nested=True).unionByName(docs.filter("md IS NULL"))
    return out.select(day_text(F.col("briefing_date")).alias("briefing_date"), F.md5("md").alias("md"))


@query(
    "S17_read_graph_json",
    ", n AS (SELECT 'd'||doc_id||'gpu'||i AS concept, CASE WHEN i%2=0 THEN 'Given' ELSE 'Hardware & Infrastructure' END AS category, "
    "doc_id, i, max(i) OVER (PARTITION BY doc_id) AS m FROM line) "
    "SELECT n.concept, n.category, o.concept AS next FROM n LEFT JOIN n o ON o.doc_id=n.doc_id AND o.i=n.i+1",
    ["line"],
)
def s17(t):
    key = lambda i: F.concat(F.lit("d"), F.col("doc_id"), F.lit("gpu"), i)
    nodes = json_lines(
        lambda x, i: F.struct(
            key(i).alias("id"), F.when(i % 2 == 0, "Given").alias("category"),
            F.length(x).alias("encounter_count"),
        )
    )
    links = F.transform(
        F.slice("l", 2, F.size("l")),
        lambda x, i: F.struct(key(i).alias("source"), key(i + 1).alias("target")),
    )
    docs = t.documents.withColumn("l", F.split("text", "\n")).select(
        F.concat("doc_id", F.lit(".json")).alias("path"),
        F.to_json(F.struct(nodes.alias("nodes"), links.alias("links"))).alias("content"),
    )
    root = Scratch(t.spark, "graph").root
    write_documents(docs, root)
    nodes, edges = files.read_graph_json(t.spark, root)
    order = lambda c: F.regexp_extract(c, r"gpu(\d+)\z", 1).cast("long")
    first = F.when(order("a") < order("b"), F.col("a")).otherwise(F.col("b"))
    second = F.when(order("a") < order("b"), F.col("b")).otherwise(F.col("a"))
    follow = edges.select(first.alias("concept"), second.alias("next"))
    return nodes.join(follow, "concept", "left").select("concept", "category", "next")


@query(
    "S18_select_sources",
    "SELECT 'SRC '||(s_suppkey%30) AS asked, count(*) AS n, "
    "bool_or(regexp_replace(lower('SRC '||(s_suppkey%30)), '[^a-z0-9]','','g') IN (SELECT name FROM sources)) AS matched "
    "FROM supplier GROUP BY 1 ORDER BY 1",
    ["sources"],
)
def s18(t):
    asked = t.read("supplier").select(
        F.concat(F.lit("SRC "), F.col("s_suppkey") % 30).alias("name")
    )
    per_name = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    chosen = registry.select_sources(t.sources, asked)
    keyed = chosen.select(
        registry.slug(F.col("source_name")).alias("key"), "matched"
    )
    return (
        per_name.withColumn("key", registry.slug(F.col("name")))
        .join(keyed, "key")
        .select(F.col("name").alias("asked"), "n", "matched")
    )


@query(
    "S19_skip_scraped",
    ", sr AS (SELECT 'src'||(event_id%40) AS source_name, min(ts) AS last_run_at FROM events GROUP BY event_id%40), "
    "lr AS (SELECT min(ts) + INTERVAL 2 HOUR AS t FROM events) "
    "SELECT name FROM sources WHERE name NOT IN (SELECT source_name FROM sr, lr WHERE last_run_at > t)",
    ["sources"],
)
def s19(t):
    source_runs = t.events.groupBy(
        F.concat(F.lit("src"), F.col("event_id") % 40).alias("source_name")
    ).agg(F.min("ts").alias("last_run_at"))
    runs = t.events.agg((F.min("ts") + F.expr("INTERVAL 2 HOURS")).alias("completed_at"))
    return registry.skip_scraped(t.sources, source_runs, runs).select("name")


@query(
    "S20_cap_per_source",
    "SELECT url, source_name FROM entry JOIN sources ON name=source_name "
    "QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY feed_pos) <= max_articles",
    ["entry", "sources"],
)
def s20(t):
    return registry.cap_per_source(t.entry, t.sources, ["feed_pos"]).select("url", "source_name")


@query(
    "S21_union_sources",
    "SELECT url, title FROM entry UNION ALL SELECT url, NULL FROM pages UNION ALL SELECT url, title FROM entry",
    ["entry"],
)
def s21(t):
    return registry.union_sources(
        t.entry.select("url", "title"), t.pages.select("url"), t.entry.select("url", "title")
    )


@query(
    "S0_parse_landed",
    f"SELECT kind, count(*) AS n FROM (SELECT 'a' AS kind {_HEAD} UNION ALL SELECT 'b' {_HEAD}) GROUP BY 1",
    ["line"],
)
def s0(t):
    rss = landed(t, rss_payload()).withColumn("kind", F.lit("substack_feed"))
    atom = landed(t, atom_payload()).withColumn("kind", F.lit("arxiv_feed"))
    parsed = registry.parse_landed(rss.unionByName(atom), ["substack_feed", "arxiv_feed"])
    kind = F.when(F.col("url").startswith("http://x/"), F.lit("a")).otherwise(F.lit("b"))
    return parsed.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
