"""Model plug-in points with their built-ins, streaming forms and a whole run."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsweft.catalog.core import VIEW_SQL, _DEPENDS, now, query, sql_strip, stamp
from newsweft.catalog.graph_queries import _ADJ, edges, nodes, questions
from newsweft.catalog.store_queries import visit_in
from newsweft.lineage import Scratch
from newsweft.operators import checks, models, select
from newsweft.params import Params
from newsweft.plans.daily import State, run_day
from newsweft.plans.staging import StageStore
from newsweft.schemas import ARTICLES, FAILURES, FEEDBACK, NODES, VECTORS, VISITED
from newsweft.streaming import visits

INTERESTS = models.Interests(["tion", "eau", "sch"], ["the", "que"], ["zzz", "unic"])
CHUNKED = Params(max_chunk_tokens=100)

_T = "lower(title||chr(10)||snippet)"
_COUNT = lambda terms: "+".join(f"CAST(contains({_T}, '{t}') AS INTEGER)" for t in terms)


@query(
    "U1_score_relevance",
    f"SELECT url, CASE WHEN {_COUNT(INTERESTS.excluded)} > 0 THEN 0 ELSE least(10, 3*({_COUNT(INTERESTS.primary)})+({_COUNT(INTERESTS.secondary)})) END AS score, "
    f"CASE WHEN {_COUNT(INTERESTS.excluded)} > 0 THEN 'excluded term' ELSE ({_COUNT(INTERESTS.primary)})||' primary, '||({_COUNT(INTERESTS.secondary)})||' secondary terms' END AS justification FROM entry",
    ["entry"],
)
def u1(t):
    return models.score_relevance(t.entry, INTERESTS)[0].select("url", "score", "justification")


@query(
    "U1_custom_scorer",
    "SELECT url, CAST(CASE WHEN length(title)%13 <= 10 THEN length(title)%13 END AS INTEGER) AS score FROM entry",
    ["entry"],
)
def u1b(t):
    @F.pandas_udf("score int, justification string")
    def scorer(text: pd.Series) -> pd.DataFrame:
        n = text.str.split("\n", n=1).str[0].str.len() % 13
        return pd.DataFrame({"score": n.astype("int32"), "justification": "length"})

    ok, failed = models.score_relevance(t.entry, INTERESTS, scorer)
    return ok.select("url", "score").unionByName(
        failed.select("url", F.lit(None).cast("int").alias("score"))
    )


@query(
    "U2_embed",
    ", w AS (SELECT url, unnest(regexp_split_to_array(lower(array_to_string(key_concepts, ', ')||'. '||summary), '[^\\p{L}\\p{N}]+')) AS w FROM articles), "
    "c AS (SELECT url, ('0x'||substr(md5(w),1,8))::BIGINT % 256 AS b, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), "
    "v AS (SELECT url, b, (n / sqrt(sum(n*n) OVER (PARTITION BY url)))::FLOAT::DOUBLE AS x FROM c) "
    "SELECT url, md5(string_agg(b||':'||floor(x*100000+0.5)::BIGINT, ' ' ORDER BY b)) AS used FROM v GROUP BY url",
    ["articles"],
)
def u2(t):
    """Every dimension in use, to five digits."""
    rows = models.embed(t.articles.select("url", "key_concepts", "summary"))
    named = F.transform("embedding", lambda x, b: F.when(x != 0, F.concat(b, F.lit(":"), F.floor(x.cast("double") * 100000 + 0.5))))
    return rows.select("url", F.md5(F.array_join(named, " ")).alias("used"))


@query(
    "U2_custom_embedder",
    "SELECT url, CAST(2 AS BIGINT) AS dim, CAST(length(array_to_string(key_concepts, ', ')||'. '||summary) AS DOUBLE) AS first FROM articles",
    ["articles"],
)
def u2b(t):
    @F.pandas_udf("array<double>")
    def embedder(text: pd.Series) -> pd.Series:
        return text.map(lambda x: np.array([len(x), 1.0]))

    rows = models.embed(t.articles.select("url", "key_concepts", "summary"), embedder)
    return rows.select(
        "url", F.size("embedding").cast("long").alias("dim"),
        F.get("embedding", F.lit(0)).cast("double").alias("first"),
    )


def sql_sentences(e):
    return (
        f"list_filter(list_transform(regexp_extract_all({e}, '[^.!?]+[.!?]*'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
    )


VIEW_SQL["rare"] = (
    "SELECT url, list(term ORDER BY df, term) AS kc FROM (SELECT url, term, df, row_number() OVER (PARTITION BY url ORDER BY df, term) AS rn "
    "FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT DISTINCT 'doc:'||doc_id AS url, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) "
    "WHERE length(term) > 3)) WHERE rn <= 8 GROUP BY url"
)


def bodies(t):
    return t.documents.select(
        F.concat(F.lit("doc:"), "doc_id").alias("url"), F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("source_name"),
        F.col("text").alias("body"),
    )


@query(
    "U3_rare_terms",
    "SELECT url, array_to_string(kc, '|') AS key_concepts FROM rare",
    ["rare"],
)
def u3_terms(t):
    return models.rare_terms(bodies(t)).select(
        "url", F.array_join("key_concepts", "|").alias("key_concepts")
    )


_CHUNKS = (
    "s AS (SELECT doc_id, text, list_reduce(list_prepend({'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT, 'k': 0::BIGINT}, "
    "list_transform(string_split(text, chr(10)), lambda p: {'done': []::VARCHAR[], 'cur': p, 'n': length(p), 'k': 1::BIGINT})), lambda a, p: "
    "CASE WHEN a.k > 0 AND a.n + p.n > 400 THEN {'done': list_append(a.done, a.cur), 'cur': p.cur, 'n': p.n, 'k': 1::BIGINT} "
    "WHEN a.k > 0 THEN {'done': a.done, 'cur': a.cur || chr(10) || p.cur, 'n': a.n + p.n, 'k': a.k + 1} ELSE {'done': a.done, 'cur': p.cur, 'n': p.n, 'k': 1::BIGINT} END) AS st FROM documents), "
    "c AS (SELECT doc_id, text, length(text)//4 > 100 AS big, list_append(st.done, st.cur) AS ch FROM s), "
    "p AS (SELECT doc_id, text, big, list_filter(list_transform(ch, lambda y: array_to_string(" + sql_sentences("y") + "[1:3], ' ')), lambda y: y <> '') AS ps FROM c), "
    "r AS (SELECT doc_id, text, big, CASE WHEN NOT big THEN text WHEN len(ps) > 0 THEN array_to_string(list_transform(ps, lambda y, i: '[Part '||i||'] '||y), chr(10)||chr(10)) END AS to_read FROM p)"
)


@query(
    "U3_summarize",
    f"WITH {_CHUNKS}, z AS (SELECT doc_id, text, {sql_sentences('to_read')} AS se FROM r WHERE to_read IS NOT NULL) "
    "SELECT 'doc:'||doc_id AS url, md5(array_to_string(se[1:3], ' ')) AS summary, md5(coalesce(se[len(se)], '')) AS novel_insights, "
    "CAST(least(5, 1+length(text)//2000) AS INTEGER) AS technical_depth FROM z",
)
def u3(t):
    out = models.summarize(bodies(t), CHUNKED, now(), separator="\n")
    return out.select(
        "url", F.md5("summary").alias("summary"), F.md5("novel_insights").alias("novel_insights"), "technical_depth"
    )


def asked(t):
    """Questions about parts, each with a stored vector."""
    v = t.embeddings.select("vec_id", "embedding")
    return questions(t).join(v, F.col("question_id") % 500 == F.col("vec_id")).drop("vec_id")


def stored(t):
    v = F.col("vec_id")
    return t.embeddings.select(
        F.concat(F.lit("v"), v).alias("url"), "embedding", F.concat(F.lit("T"), v).alias("title"),
        F.concat(F.lit("s"), "label").alias("source"), F.concat(F.lit("doc "), v).alias("document"),
    )


@query(
    "U4_retrieve_context",
    f", {_ADJ}, q AS (SELECT question_id, question, embedding::DOUBLE[] AS e FROM questions JOIN embeddings ON vec_id=question_id%500), "
    "k AS (SELECT q.question_id, s.vec_id AS v, floor(list_cosine_similarity(q.e, s.embedding::DOUBLE[])*1000000+0.5)/1000000 AS sim, row_number() OVER "
    "(PARTITION BY q.question_id ORDER BY floor(list_cosine_similarity(q.e, s.embedding::DOUBLE[])*1000000+0.5) DESC, 'v'||s.vec_id) AS rank FROM q, embeddings s QUALIFY rank <= 10), "
    "a AS (SELECT question_id, string_agg('v'||v, '|' ORDER BY rank) AS sources, count(*) AS n FROM k GROUP BY question_id), "
    "r AS (SELECT question_id, concept FROM matched UNION SELECT question_id, n FROM matched JOIN adj ON c=concept), "
    "rc AS (SELECT question_id, string_agg(concept, '|' ORDER BY concept) AS related FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY concept) <= 15) GROUP BY question_id) "
    "SELECT q.question_id, a.sources, coalesce(related, '') AS related, true AS starts_well FROM q JOIN a USING (question_id) LEFT JOIN rc USING (question_id)",
    ["matched", "edges"],
)
def u4(t):
    out = models.retrieve_context(asked(t), stored(t), nodes(t), edges(t))
    good = F.col("context").startswith('[Article 1] "T') & F.contains("context", F.lit("\n[Article 10] "))
    return out.select(
        "question_id", F.array_join(F.transform("sources", lambda s: s["url"]), "|").alias("sources"),
        F.array_join("related_concepts", "|").alias("related"), good.alias("starts_well"),
    )


@query(
    "U5_parse_model_output",
    "SELECT conv_id, turn, length(text) AS n, md5(text) AS body FROM conversations",
)
def u5(t):
    answer = F.to_json(F.struct(F.length("text").alias("n"), F.col("text").alias("body")))
    raw = F.concat(F.lit("<think>x</think>\n```json\n"), answer, F.lit("\n```"))
    rows = t.conversations.select("conv_id", "turn", raw.alias("raw"))
    parsed = checks.parse_model_output(rows, "n bigint, body string")
    return parsed.select(
        "conv_id", "turn", "parsed.n",
        F.md5("parsed.body").alias("body"),
    )


@query(
    "U6_table_functions",
    r"SELECT page_id, count(*) AS links, md5(string_agg(h, '|' ORDER BY i)) AS hrefs FROM (SELECT page_id, i, l[i] AS h FROM "
    r"(SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 1) AS l FROM pages), unnest(range(1, len(l)+1)) AS t(i)) GROUP BY page_id",
)
def u6(t):
    models.register_table_functions(t.spark)
    t.pages.createOrReplaceTempView("nw_pages")
    return t.spark.sql(
        "SELECT page_id, count(*) AS links, md5(array_join(transform(array_sort(collect_list(struct(pos, href))), x -> x.href), '|')) AS hrefs "
        "FROM nw_pages, LATERAL nw_html_links(html) GROUP BY page_id"
    )


@query(
    "U6_chunk_function",
    "WITH " + _CHUNKS.split(", p AS (")[0].replace("chr(10)", "chr(10)||chr(10)").replace("FROM documents", "FROM doubled").replace("s AS (", "doubled AS (SELECT doc_id, replace(text, chr(10), chr(10)||chr(10)) AS text FROM documents), s AS (", 1) + " SELECT doc_id, CASE WHEN big THEN len(ch) ELSE 1 END AS chunks, "
    "md5(CASE WHEN big THEN array_to_string(list_transform(list_sort(ch), lambda x: md5(x)), '') ELSE md5(text) END) AS digest FROM c",
)
def u6b(t):
    models.register_table_functions(t.spark)
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    t.documents.withColumn("text", doubled).createOrReplaceTempView("nw_documents")
    return t.spark.sql(
        "SELECT doc_id, count(*) AS chunks, md5(array_join(transform(array_sort(collect_list(chunk)), x -> md5(x)), '')) AS digest "
        "FROM nw_documents, LATERAL nw_chunk_text(text, 100) GROUP BY doc_id"
    )


# -- streams: the events replayed as files -------------------------------------------------------


BATCHES = ("2024-01-11", "2024-01-21", "2024-02-28")  # where replayed batches end; the last has no end


def replay(t, name, rows, order, ends, start):
    """Hand the rows to a stream in batches, each written as many files and run to its end. ``ends`` are
    values of ``order``: the last batch has no end. ``start(stream, root)`` starts the query, which goes
    on from its checkpoint; no limit of time cuts it."""
    root = Scratch(t.spark, name).root
    batch = sum(((order >= end).cast("int") for end in ends), F.lit(0))
    for i in range(len(ends) + 1):
        rows.filter(batch == i).write.mode("append").parquet(f"{root}/in")
        start(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root).awaitTermination()
    return root


_UNSEEN = "SELECT DISTINCT url, NULL::TIMESTAMP AS began, false AS briefed FROM e"
_SEEDED = (
    "SELECT 'u'||user_id AS url, CASE WHEN user_id%3=0 THEN min(ts) - INTERVAL 1 DAY * (user_id%20) END AS began, "
    "user_id%6=0 AS briefed FROM events GROUP BY user_id"
)


def _sql_windows(days: int, briefed_days: int, seen: str = _UNSEEN) -> str:
    """Each batch against the windows that the batches before it left."""
    b = "".join(f" + (ts >= TIMESTAMP '{x}')::INTEGER" for x in BATCHES[:-1])
    ctes = [
        "e AS (SELECT 'u'||user_id AS url, ts, event_id AS seq, event_type='purchase' AS mark, 0" + b + " AS b FROM events)",
        f"w0 AS ({seen})",
    ]
    for i in range(len(BATCHES)):
        fits = "began IS NULL" + "".join(
            f" OR (briefed = {flag} AND ts - INTERVAL {n} DAY >= began)" for flag, n in (("true", briefed_days), ("false", days)) if days
        )
        ctes += [
            f"o{i} AS (SELECT e.url, e.ts, e.seq FROM e JOIN w{i} USING (url) WHERE b={i} AND NOT mark AND ({fits}))",
            f"n{i} AS (SELECT w.url, coalesce((SELECT max(ts) FROM o{i} o WHERE o.url=w.url), began) AS began, "
            f"briefed AND NOT EXISTS (SELECT 1 FROM o{i} o WHERE o.url=w.url) AS held, "
            f"(SELECT max(ts) FROM e WHERE e.url=w.url AND b={i} AND mark) AS marked FROM w{i} w)",
            f"w{i + 1} AS (SELECT url, began, held OR coalesce(marked >= began, false) AS briefed FROM n{i})",
        ]
    out = " UNION ALL ".join(f"SELECT url, seq FROM o{i}" for i in range(len(BATCHES)))
    return "WITH " + ", ".join(ctes) + " " + out


def _stream_visits(t, params, visited=None):
    rows = t.events.select(
        F.concat(F.lit("u"), "user_id").alias("url"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "briefed").otherwise("entry").alias("kind"),
    )
    start = lambda stream, root: (
        visits.stream_filter_new(stream, params, visited)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/out")
        .trigger(availableNow=True)
        .start()
    )
    # rows without a time have no window and are in no batch, as in the SQL
    root = replay(t, "visits", rows, F.col("ts"), [F.lit(x).cast("timestamp") for x in BATCHES[:-1]], start)
    return t.spark.read.schema("url string, ts timestamp, seq bigint").parquet(f"{root}/out").select("url", "seq")


@query("M1_stream_filter_new", _sql_windows(2, 12))
def m1(t):
    """Three batches; windows short enough for some urls to come again and some not."""
    return _stream_visits(t, Params(dedup_days=2, briefed_dedup_days=12))


@query("M1_stream_never_again", _sql_windows(0, 12))
def m1_never(t):
    return _stream_visits(t, Params(dedup_days=0, briefed_dedup_days=12))


@query("M1_stream_seeded", _sql_windows(4, 12, _SEEDED))
def m1_seeded(t):
    """The stream goes on from a table of visits: a third of the urls was seen before, half of these briefed."""
    user = F.col("user_id")
    visited = t.events.filter(user % 3 == 0).groupBy(user).agg(
        (F.min("ts") - F.make_dt_interval((user % 20).cast("int"))).alias("first_seen")
    ).select(F.concat(F.lit("u"), user).alias("url"), "first_seen", (user % 2 == 0).alias("was_briefed"))
    return _stream_visits(t, Params(dedup_days=4, briefed_dedup_days=12), visited)


@query(
    "M1_stream_dedup_week",
    "SELECT 'u'||user_id||'/'||k AS url FROM ev WHERE ts IS NOT NULL GROUP BY user_id, k",
    ["ev"],
)
def m1_week(t):
    """The window is longer than the events span, so every url comes once."""
    k = F.get_json_object("props", "$.k")
    rows = t.events.select(F.concat(F.lit("u"), "user_id", F.lit("/"), k).alias("url"), "ts", F.col("event_id").alias("seq"))
    start = lambda stream, root: (
        visits.stream_dedup_week(stream, 366)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/out")
        .trigger(availableNow=True)
        .start()
    )
    root = replay(t, "week", rows, F.col("ts"), [F.lit(x).cast("timestamp") for x in BATCHES[:-1]], start)
    return t.spark.read.schema(rows.schema).parquet(f"{root}/out").select("url")


@query(
    "M2_stream_failures",
    "SELECT url, phase, arg_max(error_type, seq) AS error_type, count(*)-1 AS retry_count FROM failures_in GROUP BY url, phase",
    ["failures_in"],
)
def m2(t):
    table = lambda root: visits.FailureTable(t.spark, f"{root}/table")
    start = lambda stream, root: (
        visits.stream_failures(stream, table(root), now())
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    # cut where the dates begin, but by seq, which rows without a time have too and which tells the last error
    begins = [F.min(F.when(F.col("failed_at") >= F.lit(x).cast("timestamp"), F.col("seq"))) for x in BATCHES[:-1]]
    ends = [F.lit(n) for n in t.failures_in.agg(*begins).first() if n is not None]
    root = replay(t, "failures", t.failures_in, F.coalesce("seq", F.lit(-1)), ends, start)
    return table(root).read().select("url", "phase", "error_type", "retry_count")


def daily_inputs(t):
    """State, payloads, sources, pages and forms: documents as feeds, and as bodies of their entries."""
    from newsweft.catalog.briefing_queries import forms
    from newsweft.catalog.source_queries import landed, rss_payload

    spark = t.spark
    empty = lambda ddl: spark.createDataFrame([], ddl)
    payloads = landed(t, rss_payload()).withColumn("kind", F.lit("substack_feed"))
    sources = t.sources.withColumn("max_articles", F.lit(1000))
    # every entry has a page: the body of its document
    pages = t.documents.select(
        F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).alias("i"), "doc_id", "text"
    ).select(
        F.concat(F.lit("http://x/"), "doc_id", F.lit("/"), "i").alias("url"),
        F.concat(F.lit("<html><article>"), "text", F.lit("</article></html>")).alias("html"),
    )
    vectors = models.embed(t.articles.select("url", "key_concepts", "summary", "title", "source_name")).select(
        "url", "embedding", "title", F.col("source_name").alias("source"), F.col("text").alias("document")
    )
    vectors = Scratch(spark, "vectors").put(vectors)  # a table, as the state of a run is: a search reads it several times
    state = State(
        visited=t.visited, articles=t.articles, vectors=vectors,
        nodes=t.event_nodes.withColumns(
            {"category": F.lit(None).cast("string"), "interest_score": F.lit(None).cast("double"), "interest_count": F.lit(None).cast("long")}
        ),
        edges=t.sparse_edges.limit(0), edge_sources=empty("a string, b string, url string, seq bigint"),
        failures=empty(FAILURES), feedback=t.feedback.select("briefing_date", "article_number", "title", "read", "interest", "quality", "processed_at"),
    )
    return state, payloads, sources, pages, forms(t)


@query("P2_daily_run")
def daily_run(t):
    """All stages over the documents as feeds and the pages as article bodies."""
    store = StageStore(t.spark, Scratch(t.spark, "daily").root, "2024-01-31")
    _, md, funnel = run_day(
        *daily_inputs(t), INTERESTS, Params(), store, briefing_date="2024-01-31", now=now(), duration_s=0.0
    )
    return md.select("briefing_date", "md")
