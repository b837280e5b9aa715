"""Text expressions and predicates over documents, pages, conversations and events."""

from pyspark.sql import functions as F

from newsweft.catalog.core import (
    query,
    now,
    sql_clean,
    sql_drop_elements,
    sql_round,
    sql_strip,
    sql_strip_tags,
)
from newsweft.functions import concepts as C
from newsweft.functions import scoring, text, urls
from newsweft.functions.concepts import CATEGORIES, SYNONYMS
from newsweft.operators import checks

_PHRASES = (
    "Large-Language Models", " Machine_Learning ", "Graph Neural Networks", "AI agents",
    "kv/cache", "vLLM serving", "world storage", "Analysis", "bus", "paper reviews",
)


def phrases(t):
    """Concept spellings derived from the events."""
    pick = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), F.col("k") % 10 + 1)
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(pick, F.lit(" "), "user_id"))
        .otherwise(pick)
        .alias("raw"),
    )


_SQL_PHRASES = (
    "phrases AS (SELECT event_id, ([" + ",".join(f"'{p}'" for p in _PHRASES) + "])[k%10+1]"
    " || CASE WHEN event_type='error' THEN ' '||user_id ELSE '' END AS raw FROM ev)"
)
_SQL_SYNONYMS = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + " END"


def sql_norm(e: str) -> str:
    loose = f"regexp_replace(lower({sql_strip(e)}), '[-_/]', ' ', 'g')"
    squeezed = r"regexp_replace(x, '[\s]+', '', 'g')"
    single = (
        f"CASE WHEN {squeezed} LIKE '%s' AND length({squeezed})>3 "
        f"THEN left({squeezed}, length({squeezed})-1) ELSE {squeezed} END"
    )
    return f"list_transform([{loose}], lambda x: coalesce({_SQL_SYNONYMS}, {single}))[1]"


def sql_category(e: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({e}, '{'|'.join(w.replace('.', chr(92) + '.') for w in ws)}') THEN '{n}'"
        for n, ws in CATEGORIES.items()
    )
    return f"CASE {arms} ELSE 'Uncategorized' END"


@query(
    "X1_normalize_concept",
    f", {_SQL_PHRASES} SELECT raw, {sql_norm('raw')} AS concept, count(*) AS n FROM phrases GROUP BY ALL",
    ["ev"],
)
def x1(t):
    return phrases(t).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", C.normalize_concept(F.col("raw")).alias("concept"), "n"
    )


@query(
    "O3_distinct_concepts",
    f", {_SQL_PHRASES}, n AS (SELECT user_id, event_id, {sql_norm('raw')} AS concept FROM phrases JOIN ev USING (event_id)), "
    "f AS (SELECT user_id, concept, min(event_id) AS first FROM n GROUP BY ALL) "
    "SELECT user_id, string_agg(concept, '|' ORDER BY first) AS concepts FROM f GROUP BY user_id",
    ["ev"],
)
def o3(t):
    rows = phrases(t).join(t.events.select("event_id", "user_id"), "event_id")
    listed = F.array_sort(F.collect_list(F.struct("event_id", "raw")))
    named = rows.groupBy("user_id").agg(F.transform(listed, lambda x: x["raw"]).alias("raw"))
    return named.select("user_id", F.array_join(C.normalize_concepts(F.col("raw")), "|").alias("concepts"))


@query(
    "X1_normalize_words",
    f"SELECT concept, count(*) AS n FROM (SELECT {sql_norm('w')} AS concept FROM "
    "(SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY 1",
)
def x1_words(t):
    # the expression is priced once per distinct word, not once per occurrence
    words = t.documents.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count()
    return (
        words.groupBy(C.normalize_concept(F.col("w")).alias("concept"))
        .agg(F.sum("count").alias("n"))
    )


@query(
    "X2_assign_category",
    f", {_SQL_PHRASES}, n AS (SELECT event_id, {sql_norm('raw')} AS concept FROM phrases) "
    f"SELECT {sql_category('concept')} AS category, count(*) AS n, count(DISTINCT concept) AS concepts "
    "FROM n GROUP BY 1",
    ["ev"],
)
def x2(t):
    per_form = phrases(t).groupBy(C.normalize_concept(F.col("raw")).alias("concept")).count()
    return per_form.groupBy(C.assign_category(F.col("concept")).alias("category")).agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("concepts")
    )


@query(
    "X3_slug",
    "SELECT DISTINCT s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS slug FROM supplier",
)
def x3(t):
    return t.read("supplier").select(
        F.col("s_name").alias("name"), text.slug(F.col("s_name")).alias("slug")
    ).distinct()


@query(
    "X4_strip_tags",
    f"SELECT page_id, md5({sql_strip_tags('html')}) AS stripped, "
    f"md5({sql_drop_elements('html')}) AS dropped FROM pages",
)
def x4(t):
    return t.pages.select(
        "page_id",
        F.md5(text.strip_tags(F.col("html"))).alias("stripped"),
        F.md5(text.drop_elements(F.col("html"))).alias("dropped"),
    )


SQL_BODY = (
    f"d AS (SELECT page_id, url, {sql_drop_elements('html')} AS h FROM pages), "
    r"p AS (SELECT page_id, url, h, "
    + sql_strip_tags(r"regexp_extract(h, '(?is)<article[\s>].*?</article>')")
    + " AS art, "
    + sql_strip_tags(r"regexp_extract(h, '(?is)<main[\s>].*?</main>')")
    + r" AS mn, list_transform(regexp_extract_all(h, '(?is)<div[\s>].*?</div>'), lambda x: "
    + sql_strip_tags("x")
    + ") AS divs FROM d), "
    "q AS (SELECT *, coalesce(divs[list_position(list_transform(divs, lambda x: length(x)), "
    "list_max(list_transform(divs, lambda x: length(x))))], '') AS dv FROM p), "
    "body AS (SELECT page_id, url, "
    + sql_clean(
        "CASE WHEN length(art)>=200 THEN art WHEN length(mn)>=200 THEN mn "
        f"WHEN length(dv)>=100 THEN dv ELSE {sql_strip_tags('h')} END"
    )
    + " AS body FROM q)"
)


@query("X5_extract_body", f"WITH {SQL_BODY} SELECT page_id, length(body) AS n, md5(body) AS body FROM body")
def x5(t):
    body = t.pages.select("page_id", text.extract_body(F.col("html")).alias("body"))
    return body.select(
        "page_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("body")
    )


@query("X6_clean_text", f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned FROM documents")
def x6(t):
    return t.documents.select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("X7_estimate_tokens", "SELECT doc_id, length(text)//4 AS tokens FROM documents")
def x7(t):
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "X8_chunk_text",
    # state: done chunks, open chunk, its length without separators, whether it is open
    "WITH s AS (SELECT doc_id, text, list_reduce(list_prepend("
    "{'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT, 'k': 0::BIGINT}, "
    "list_transform(string_split(text, chr(10)), lambda p: "
    "{'done': []::VARCHAR[], 'cur': p, 'n': length(p), 'k': 1::BIGINT})), lambda a, p: "
    "CASE WHEN a.k > 0 AND a.n + p.n > 200 THEN {'done': list_append(a.done, a.cur), 'cur': p.cur, "
    "'n': p.n, 'k': 1::BIGINT} WHEN a.k > 0 THEN {'done': a.done, 'cur': a.cur || chr(10) || p.cur, "
    "'n': a.n + p.n, 'k': a.k + 1} ELSE {'done': a.done, 'cur': p.cur, 'n': p.n, 'k': 1::BIGINT} END) AS st "
    "FROM documents), c AS (SELECT doc_id, CASE WHEN length(text)//4 <= 50 THEN [text] "
    "ELSE list_append(st.done, st.cur) END AS chunks FROM s) "
    "SELECT doc_id, len(chunks) AS chunks, md5(array_to_string(chunks, '|#|')) AS digest FROM c",
)
def x8(t):
    chunks = text.chunk_text(F.col("text"), 50, separator="\n")
    return t.documents.select("doc_id", chunks.alias("c")).select(
        "doc_id",
        F.size("c").cast("long").alias("chunks"),
        F.md5(F.array_join("c", "|#|")).alias("digest"),
    )


@query(
    "X9_embed_text",
    "SELECT url, md5(array_to_string(key_concepts, ', ') || '. ' || summary) AS digest FROM articles",
    ["articles"],
)
def x9(t):
    return t.articles.select(
        "url", F.md5(text.embed_text(F.col("key_concepts"), F.col("summary"))).alias("digest")
    )


@query(
    "X11_resolve_url",
    r", l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)"
    r" SELECT href, regexp_extract(url, '^https?://[^/]+') || href AS resolved, count(*) AS n "
    r"FROM l GROUP BY ALL".replace(", l AS", "WITH l AS", 1),
)
def x11(t):
    refs = t.pages.select(
        "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")
    )
    return (
        refs.groupBy("url", "href")
        .count()
        .select("href", urls.resolve_url(F.col("url"), F.col("href")).alias("resolved"), "count")
        .groupBy("href", "resolved")
        .agg(F.sum("count").alias("n"))
    )


@query(
    "X13_extract_json",
    "SELECT conv_id, turn, md5(" + sql_strip("text") + ") AS answer FROM conversations",
)
def x13(t):
    raw = F.concat(
        F.lit("<think>hm\n{}</think>\nHere:\n```json\n"), "text", F.lit("\n```\nrest ```x```")
    )
    return t.conversations.select(
        "conv_id", "turn", F.md5(text.extract_json(raw)).alias("answer")
    )


@query(
    "X14_briefing_urls",
    "SELECT doc_id, CAST(2 AS BIGINT) AS n, 'http://a/'||doc_id||'|http://b/'||lang AS urls FROM documents",
)
def x14(t):
    md = F.concat(
        F.lit("[Read original](http://a/"), "doc_id", F.lit(")\n"),
        F.regexp_replace("text", r"\[", "("),
        F.lit("\n[Read original](http://b/"), "lang", F.lit(")"),
    )
    return t.documents.select("doc_id", text.briefing_urls(md).alias("u")).select(
        "doc_id", F.size("u").cast("long").alias("n"), F.array_join("u", "|").alias("urls")
    )


@query(
    "X15_truncate_title",
    "SELECT doc_id, "
    + sql_strip("replace(substring(text,1,120), chr(10), ' ')")
    + " || CASE WHEN length(text)>120 THEN '...' ELSE '' END AS post_title, "
    "CASE WHEN length(text)>120 THEN substring(text,1,117)||'...' ELSE text END AS toot_title FROM documents",
)
def x15(t):
    return t.documents.select(
        "doc_id",
        text.post_title(F.col("text")).alias("post_title"),
        text.toot_title(F.col("text")).alias("toot_title"),
    )


@query(
    "X16_parse_lists",
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: "
    + sql_strip("x")
    + "), lambda x: x <> ''), '|') AS items, lang || '|' || source AS ticks FROM documents",
)
def x16(t):
    line = F.concat(F.lit("` "), "lang", F.lit("`, `"), "source", F.lit(" `"))
    return t.documents.select(
        "doc_id",
        F.array_join(text.parse_comma_list(F.col("text")), "|").alias("items"),
        F.array_join(text.parse_ticks(line), "|").alias("ticks"),
    )


@query(
    "X19_safe_filename",
    r"""SELECT doc_id, CASE WHEN f = '' THEN 'unnamed' ELSE f END AS name FROM (SELECT doc_id,
    trim(regexp_replace(split_part(text, chr(10), 1), '[<>:"/\\|?*]', '_', 'g'), '. ') AS f FROM documents)""",
)
def x19(t):
    return t.documents.select(
        "doc_id", text.safe_filename(F.substring_index("text", "\n", 1)).alias("name")
    )


@query(
    "X20_format_duration",
    "SELECT event_id, CASE WHEN value < 60 THEN (floor(value*10+0.5)::BIGINT//10)||'.'||(floor(value*10+0.5)::BIGINT%10)||'s' ELSE "
    "floor(value/60)::BIGINT||'m '||floor(value - floor(value/60)*60 + 0.5)::BIGINT||'s' END AS took FROM events",
)
def x20(t):
    return t.events.select("event_id", text.format_duration(F.col("value")).alias("took"))


@query(
    "X21_days_since",
    "SELECT event_id, "
    + sql_round("(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts))/86400000000.0::DOUBLE", 6)
    + " AS days FROM events",
)
def x21(t):
    return t.events.select(
        "event_id", scoring.round_half_up(text.days_since(F.col("ts"), now()), 6).alias("days")
    )


@query(
    "X22_json_list",
    "SELECT event_id, CASE WHEN event_type='error' THEN '' ELSE 'k'||k||'|'||event_type END AS items FROM ev",
    ["ev"],
)
def x22(t):
    good = F.concat(F.lit('["k'), "k", F.lit('", "'), "event_type", F.lit('"]'))
    raw = F.when(F.col("event_type") == "error", F.col("props").substr(2, 99)).otherwise(good)
    return t.events.select("event_id", F.array_join(text.json_list(raw), "|").alias("items"))


@query(
    "F1_drop_cjk",
    r"SELECT url FROM entry WHERE NOT (len(regexp_extract_all(title, '\p{L}')) > 0 AND "
    r"len(regexp_extract_all(title, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) > 0.3*len(regexp_extract_all(title, '\p{L}'))) "
    r"AND NOT (len(regexp_extract_all(snippet, '\p{L}')) > 0 AND "
    r"len(regexp_extract_all(snippet, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) > 0.3*len(regexp_extract_all(snippet, '\p{L}')))",
    ["entry"],
)
def f1(t):
    return checks.drop_cjk(t.entry).select("url")


@query(
    "F2_is_challenge_page",
    r"SELECT page_id, length(html) <= 100000 AND regexp_matches(substring(html,1,15000), '(?is)"
    r"verify[^\n]{0,20}(human|not a robot|you are a)|captcha|challenge-platform|cf-browser-verification"
    r"|checking[^\n]{0,20}browser|bot[^\n]{0,15}(check|detection|protect)|security[^\n]{0,15}check"
    r"|access[^\n]{0,15}denied|please[^\n]{0,20}(enable|allow)[^\n]{0,20}(javascript|cookies)"
    r"|unusual[^\n]{0,15}traffic|automated[^\n]{0,15}access|rate[^\n]{0,10}limit') AND "
    r"len(regexp_extract_all(substring(html,1,15000), '<p|<article|<section')) < 5 AS blocked "
    r"FROM (SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN html ELSE "
    r"'<title>Checking your browser</title>' || regexp_replace(html, '<p>', '', 'g') END AS html FROM pages)",
)
def f2(t):
    # two thirds of the pages are turned into block pages to exercise both outcomes
    html = F.when(F.length("html") % 3 == 0, F.col("html")).otherwise(
        F.concat(F.lit("<title>Checking your browser</title>"), F.regexp_replace("html", "<p>", ""))
    )
    return t.pages.select("page_id", text.is_challenge_page(html).alias("blocked"))


@query("F3_usable_html", "SELECT page_id FROM pages WHERE length(html) > 500")
def f3(t):
    return checks.keep_usable_html(t.pages).select("page_id")


@query(
    "F4_body_gate",
    "SELECT 'doc:'||doc_id AS url, CASE WHEN length(text) < 100 THEN 'fetch' END AS phase, "
    "CASE WHEN length(text) < 100 THEN 'Extracted body too short ('||length(text)||' chars)' END AS error_message "
    "FROM documents",
)
def f4(t):
    docs = t.entry.join(
        t.documents.select(F.col("doc_id").alias("seq"), F.col("text").alias("body")), "seq"
    )
    ok, failed = checks.body_gate(docs)
    cols = ["url", "phase", "error_message"]
    null = F.lit(None).cast("string")
    return ok.select("url", null.alias("phase"), null.alias("error_message")).unionByName(
        failed.select(*cols)
    )


@query(
    "F8_refetch_candidates",
    r"SELECT url FROM articles WHERE length(body_content) < 100 OR regexp_matches(substring(body_content,1,500), '\{--[a-zA-Z]')",
    ["articles"],
)
def f8(t):
    return checks.refetch_candidates(t.articles).select("url")


@query(
    "F10_search_articles",
    "SELECT CAST(briefing_date AS VARCHAR) AS briefing_date, article_number, title FROM articles "
    "WHERE title ILIKE '%th_r%on%' OR summary ILIKE '%th_r%on%' OR body_content ILIKE '%th_r%on%'",
    ["articles"],
)
def f10(t):
    return checks.search_articles(t.articles, "th_r%on").select(
        F.col("briefing_date").cast("string").alias("briefing_date"), "article_number", "title"
    )


@query(
    "F13_novelty_band",
    "SELECT CASE WHEN novelty_score>=0.7 THEN 'high' WHEN novelty_score>=0.4 THEN 'mid' ELSE 'low' END AS band, "
    "count(*) AS n FROM articles GROUP BY 1",
    ["articles"],
)
def f13(t):
    return t.articles.groupBy(scoring.novelty_band(F.col("novelty_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "F14_deepening_flag",
    "SELECT url, coalesce(g < 0.4, false) AS is_deepening, CASE WHEN g >= 0.6 THEN "
    "'Introduces concepts not yet in your knowledge graph (graph novelty '||CAST(trunc(g*100) AS INTEGER)||'%)' "
    "ELSE '' END AS novelty_explanation FROM (SELECT url, CASE WHEN technical_depth<5 THEN graph_novelty END AS g FROM articles)",
    ["articles"],
)
def f14(t):
    known = t.articles.withColumn(
        "graph_novelty", F.when(F.col("technical_depth") < 5, F.col("graph_novelty"))
    )
    return checks.annotate_novelty(known).select("url", "is_deepening", "novelty_explanation")


@query(
    "F15_validate_model_output",
    "SELECT event_id, k%14-1 BETWEEN 0 AND 10 AND event_type<>'error' AS valid, "
    "CASE WHEN k%14-1 BETWEEN 0 AND 10 AND event_type<>'error' THEN k%14-1 END AS score FROM ev",
    ["ev"],
)
def f15(t):
    raw = F.concat(
        F.lit('<think>x</think>```json\n{"score": '), F.col("k") % 14 - 1,
        F.when(F.col("event_type") == "error", ', "why": "x"}\n```').otherwise(
            ', "justification": "because"}\n```'
        ),
    )
    rows = t.events.select(
        "event_id", F.concat(F.lit("u"), "event_id").alias("url"), F.lit("t").alias("title"),
        F.lit("s").alias("source_name"), raw.alias("raw"),
    )
    ok, failed = checks.validate_scores(rows)
    return ok.select("event_id", F.lit(True).alias("valid"), "score").unionByName(
        failed.select("event_id", F.lit(False).alias("valid"), F.lit(None).cast("int").alias("score"))
    )


@query(
    "F15_validate_summaries",
    "SELECT doc_id, doc_id%7 IN (0, 5, 6) AS valid, CASE WHEN doc_id%7 IN (0, 5, 6) THEN md5(text) END AS summary, "
    "CASE WHEN doc_id%7 IN (0, 5, 6) THEN CAST(1+doc_id%5 AS INTEGER) END AS technical_depth, "
    "CASE doc_id%7 WHEN 0 THEN '2024-01-31 00:00:00' WHEN 5 THEN '2024-01-31 00:00:00' WHEN 6 THEN '2024-01-02 03:04:05' END AS dated FROM documents",
)
def f15_summaries(t):
    """Answers without a summary, with a depth out of range or not whole, or with no such date fail."""
    d = F.col("doc_id") % 7
    depth = F.when(d == 2, 6.0).when(d == 3, 2.5).otherwise((F.col("doc_id") % 5 + 1).cast("double"))
    empty = F.array().cast("array<string>")
    answer = F.struct(
        F.lit("t").alias("title"), F.col("source").alias("source_name"), F.concat(F.lit("doc:"), "doc_id").alias("url"),
        F.when(d == 4, "yesterday").when(d == 5, "").when(d == 6, "2024-01-02 03:04:05").alias("date_processed"),
        F.array("lang").alias("key_concepts"), F.when(d != 1, F.col("text")).alias("summary"), F.lit("").alias("novel_insights"),
        depth.alias("technical_depth"), empty.alias("related_topics"),
    )
    rows = t.documents.select(
        "doc_id", F.concat(F.lit("doc:"), "doc_id").alias("url"), F.lit("t").alias("title"), F.col("source").alias("source_name"),
        F.to_json(answer).alias("raw"),
    )
    ok, failed = checks.validate_summaries(rows, now())
    good = ok.select(
        "doc_id", F.lit(True).alias("valid"), F.md5("summary").alias("summary"), "technical_depth",
        F.date_format("date_processed", "yyyy-MM-dd HH:mm:ss").alias("dated"),
    )
    return good.unionByName(failed.select("doc_id", F.lit(False).alias("valid")), allowMissingColumns=True)
