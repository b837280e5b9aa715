"""Keyed writes and lookups over events, documents and orders."""

from pyspark.sql import functions as F

from newsweft.catalog.core import VIEW_SQL, _DEPENDS, NOW, now, query, stamp
from newsweft.catalog.text_queries import SQL_BODY
from newsweft.lineage import Scratch
from newsweft.operators import bookmarks, checks, upsert
from newsweft.plans.staging import StageStore
from newsweft.schemas import FAILURES

MIDDLE = "2024-01-16 00:00:00"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

VIEW_SQL["visit_in"] = (
    "SELECT 'doc:'||(doc_id//3*2) AS url, split_part(text,chr(10),1) AS title, source AS source_name, "
    "(doc_id*7919)%11 >= 6 AS passed_relevance, CAST((doc_id*7919)%11 AS INTEGER) AS relevance_score, "
    "doc_id AS seq FROM documents"
)
VIEW_SQL["failures_old"] = (
    "SELECT url, phase, arg_min(title, seq) AS title, arg_min(source_name, seq) AS source_name, "
    "arg_max(error_type, seq) AS error_type, arg_max(error_message, seq) AS error_message, "
    "max(failed_at) AS failed_at, arg_max(run_id, seq) AS run_id, count(*)-1 AS retry_count "
    f"FROM failures_in WHERE failed_at < TIMESTAMP '{MIDDLE}' GROUP BY url, phase"
)
VIEW_SQL["failures_new"] = f"SELECT * FROM failures_in WHERE failed_at >= TIMESTAMP '{MIDDLE}'"
_DEPENDS["failures_old"] = _DEPENDS["failures_new"] = ["failures_in"]
VIEW_SQL["bm"] = (
    "SELECT CAST(ts AS DATE) AS briefing_date, CAST(user_id%40+1 AS INTEGER) AS article_number, "
    "CASE WHEN k%5>0 THEN CAST(k%5 AS BIGINT) END AS collection_id, min(ts) AS created_at "
    "FROM ev WHERE event_type='purchase' GROUP BY 1,2,3"
)
_DEPENDS["bm"] = ["ev"]
VIEW_SQL["bm_in"] = (
    "SELECT CAST(ts AS DATE) AS briefing_date, CAST(user_id%40+1 AS INTEGER) AS article_number, "
    "CASE WHEN k%5>0 THEN CAST(k%5 AS BIGINT) END AS collection_id, ts AS created_at "
    "FROM ev WHERE event_type='signup'"
)
_DEPENDS["bm_in"] = ["ev"]


def visit_in(t):
    score = ((F.col("doc_id") * 7919) % 11).cast("int")
    return t.documents.select(
        F.concat(F.lit("doc:"), F.expr("doc_id div 3 * 2")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("source_name"),
        (score >= 6).alias("passed_relevance"),
        score.alias("relevance_score"),
        F.col("doc_id").alias("seq"),
    )


def failure_halves(t):
    cut = F.lit(MIDDLE).cast("timestamp")
    rows = t.failures_in
    empty = t.spark.createDataFrame([], FAILURES)
    old = rows.filter(F.col("failed_at") < cut)
    seen = old.groupBy("url", "phase").agg(F.max("failed_at").alias("last_at"))
    current = (
        upsert.upsert_failures(empty, old, now())
        .join(seen, ["url", "phase"])
        .withColumn("failed_at", F.col("last_at"))
        .drop("last_at")
    )
    return current, rows.filter(F.col("failed_at") >= cut)


def bookmark_tables(t):
    rows = lambda kind: t.events.filter(F.col("event_type") == kind).select(
        F.to_date("ts").alias("briefing_date"),
        (F.col("user_id") % 40 + 1).cast("int").alias("article_number"),
        F.when(F.col("k") % 5 > 0, (F.col("k") % 5).cast("long")).alias("collection_id"),
        F.col("ts").alias("created_at"),
    )
    key = ["briefing_date", "article_number", "collection_id"]
    held = rows("purchase").groupBy(*key).agg(F.min("created_at").alias("created_at"))
    return held, rows("signup")


def collections(t):
    return t.read("region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")
    )


@query(
    "W1_upsert_visited",
    f", inc AS (SELECT * FROM visit_in QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC)=1) "
    f"SELECT url, title, source_name, {_STAMP.format('first_seen')} AS first_seen, passed_relevance, "
    "relevance_score, was_briefed FROM visited WHERE url NOT IN (SELECT url FROM inc) UNION ALL "
    f"SELECT url, title, source_name, '{NOW}', passed_relevance, relevance_score, false FROM inc",
    ["visited", "visit_in"],
)
def w1(t):
    return upsert.upsert_visited(t.visited, visit_in(t), now()).withColumn(
        "first_seen", stamp("first_seen")
    )


@query(
    "W2_mark_briefed",
    "SELECT url, was_briefed OR url IN (SELECT url FROM visit_in) AS was_briefed FROM visited",
    ["visited", "visit_in"],
)
def w2(t):
    return upsert.mark_briefed(t.visited, visit_in(t)).select("url", "was_briefed")


VIEW_SQL["art_in"] = (
    "SELECT CAST(DATE '2024-01-01' + CAST(doc_id%20 AS INTEGER) AS DATE) AS briefing_date, "
    "CAST(doc_id//20+1 AS INTEGER) AS article_number, 'new '||lang AS title FROM documents WHERE lang <> 'en'"
)


@query(
    "W3_upsert_articles",
    "SELECT CAST(briefing_date AS VARCHAR) AS briefing_date, article_number, title FROM "
    "(SELECT briefing_date, article_number, title FROM articles a WHERE NOT EXISTS (SELECT 1 FROM art_in i WHERE "
    "i.briefing_date=a.briefing_date AND i.article_number=a.article_number) UNION ALL SELECT * FROM art_in)",
    ["articles", "art_in"],
)
def w3(t):
    d = F.col("doc_id")
    inc = t.documents.filter("lang <> 'en'").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (d % 20).cast("int")).alias("briefing_date"),
        (F.expr("doc_id div 20") + 1).cast("int").alias("article_number"),
        F.concat(F.lit("new "), "lang").alias("title"),
    )
    current = t.articles.select("briefing_date", "article_number", "title")
    return upsert.upsert_articles(current, inc).withColumn(
        "briefing_date", F.col("briefing_date").cast("string")
    )


@query(
    "W4_record_run",
    "SELECT run_id, articles_scanned FROM runs WHERE run_id NOT IN (SELECT 'run'||c_custkey FROM customer) "
    "UNION ALL SELECT 'run'||c_custkey, CAST(-1 AS BIGINT) FROM customer",
    ["runs"],
)
def w4(t):
    fresh = t.read("customer").select(
        F.concat(F.lit("run"), "c_custkey").alias("run_id"),
        F.lit(-1).cast("long").alias("articles_scanned"),
    )
    return upsert.record_run(t.runs.select("run_id", "articles_scanned"), fresh)


@query(
    "W5_record_source_run",
    ", cur AS (SELECT 'src'||(event_id%40) AS s, min(ts) AS t, count(*) AS n FROM events GROUP BY event_id%40), "
    "inc AS (SELECT source AS s, max(n_chars) FILTER (WHERE doc_id = m) AS n FROM (SELECT *, max(doc_id) OVER "
    "(PARTITION BY source) AS m FROM documents) GROUP BY source) "
    f"SELECT s AS source_name, {_STAMP.format('t')} AS last_run_at, n AS articles_found FROM cur "
    f"WHERE s NOT IN (SELECT s FROM inc) UNION ALL SELECT s, '{NOW}', n FROM inc".replace(", cur AS", "WITH cur AS", 1),
)
def w5(t):
    current = t.events.groupBy(
        F.concat(F.lit("src"), F.col("event_id") % 40).alias("source_name")
    ).agg(F.min("ts").alias("last_run_at"), F.count(F.lit(1)).alias("articles_found"))
    inc = t.documents.select(
        F.col("source").alias("source_name"),
        F.col("n_chars").alias("articles_found"),
        F.col("doc_id").alias("seq"),
    )
    return upsert.record_source_run(current, inc, now()).withColumn(
        "last_run_at", stamp("last_run_at")
    )


_W6 = (
    ", g AS (SELECT url, phase, count(*) AS n, arg_min(title, seq) AS title, arg_min(source_name, seq) AS source_name, "
    "arg_max(error_type, seq) AS et, arg_max(error_message, seq) AS em, arg_max(run_id, seq) AS rid "
    "FROM failures_new GROUP BY url, phase), nxt AS (SELECT coalesce(c.url, g.url) AS url, coalesce(c.phase, g.phase) AS phase, "
    "CASE WHEN c.url IS NOT NULL THEN c.title ELSE g.title END AS title, "
    "CASE WHEN c.url IS NOT NULL THEN c.source_name ELSE g.source_name END AS source_name, "
    "coalesce(et, c.error_type) AS error_type, coalesce(em, c.error_message) AS error_message, "
    f"CASE WHEN n IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE c.failed_at END AS failed_at, coalesce(rid, c.run_id) AS run_id, "
    "CASE WHEN c.url IS NULL THEN n-1 ELSE c.retry_count+coalesce(n,0) END AS retry_count "
    "FROM failures_old c FULL JOIN g ON c.url=g.url AND c.phase=g.phase) "
)


@query(
    "W6_upsert_failures",
    _W6 + f"SELECT * EXCLUDE (failed_at), {_STAMP.format('failed_at')} AS failed_at FROM nxt",
    ["failures_old", "failures_new"],
)
def w6(t):
    current, inc = failure_halves(t)
    return upsert.upsert_failures(current, inc, now()).withColumn("failed_at", stamp("failed_at"))


@query(
    "F9_pending_failures",
    _W6 + "SELECT url, phase, retry_count FROM nxt WHERE retry_count < 3",
    ["failures_old", "failures_new"],
)
def f9(t):
    current, inc = failure_halves(t)
    return checks.pending_failures(upsert.upsert_failures(current, inc, now())).select(
        "url", "phase", "retry_count"
    )


@query(
    "W7_merge_feedback",
    f", cur AS (SELECT * FROM feedback_in WHERE processed_at < TIMESTAMP '{MIDDLE}' QUALIFY row_number() OVER "
    "(PARTITION BY briefing_date, article_number ORDER BY seq DESC)=1), "
    "inc AS (SELECT briefing_date, article_number, arg_max(read, seq) FILTER (WHERE read IS NOT NULL) AS r, "
    "arg_max(interest, seq) FILTER (WHERE interest IS NOT NULL) AS i, arg_max(quality, seq) FILTER (WHERE quality IS NOT NULL) AS q, "
    "any_value(a.title) AS title FROM (SELECT CAST(DATE '2024-01-01' + CAST(user_id%15 AS INTEGER) AS DATE) AS briefing_date, f.* EXCLUDE (briefing_date) "
    "FROM feedback_in f JOIN events e ON e.event_id=f.seq) f JOIN articles a USING (briefing_date, article_number) "
    f"WHERE f.processed_at >= TIMESTAMP '{MIDDLE}' GROUP BY ALL) "
    "SELECT CAST(coalesce(c.briefing_date, i.briefing_date) AS VARCHAR) AS briefing_date, "
    "coalesce(c.article_number, i.article_number) AS article_number, "
    "coalesce(i.title, 't'||c.article_number) AS title, coalesce(i.r, c.read, false) AS read, "
    "coalesce(i.i, c.interest) AS interest, coalesce(i.q, c.quality) AS quality, "
    f"CASE WHEN i.title IS NOT NULL THEN '{NOW}' ELSE {_STAMP.format('c.processed_at')} END AS processed_at "
    "FROM cur c FULL JOIN inc i ON c.briefing_date=i.briefing_date AND c.article_number=i.article_number",
    ["feedback_in", "articles"],
)
def w7(t):
    cut = F.lit(MIDDLE).cast("timestamp")
    key = ["briefing_date", "article_number"]
    current = upsert.last_per_key(t.feedback_in.filter(F.col("processed_at") < cut), key).select(
        *key, F.concat(F.lit("t"), "article_number").alias("title"), F.coalesce("read", F.lit(False)).alias("read"),
        "interest", "quality", "processed_at",
    )
    # the second half's feedback goes to dates of the first half
    user = t.events.select(F.col("event_id").alias("seq"), "user_id")
    inc = (
        t.feedback_in.filter(F.col("processed_at") >= cut)
        .join(user, "seq")
        .withColumn(
            "briefing_date",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 15).cast("int")),
        )
    )
    merged = upsert.merge_feedback(current, inc, t.articles, now())
    return merged.withColumns(
        {"processed_at": stamp("processed_at"), "briefing_date": F.col("briefing_date").cast("string")}
    )


@query(
    "W8_upsert_vectors",
    "WITH inc AS (SELECT 'v'||(vec_id//3*2) AS url, embedding, 'new'||vec_id AS title FROM embeddings "
    "QUALIFY row_number() OVER (PARTITION BY vec_id//3 ORDER BY vec_id DESC)=1), "
    "nxt AS (SELECT 'v'||vec_id AS url, embedding, 'old' AS title FROM embeddings WHERE 'v'||vec_id NOT IN (SELECT url FROM inc) "
    "UNION ALL SELECT * FROM inc) SELECT url, title, len(embedding) AS dim, "
    "floor(list_sum(embedding::DOUBLE[])*10000+0.5)/10000.0 AS total FROM nxt",
)
def w8(t):
    v = F.col("vec_id")
    current = t.embeddings.select(
        F.concat(F.lit("v"), v).alias("url"), "embedding", F.lit("old").alias("title")
    )
    inc = t.embeddings.select(
        F.concat(F.lit("v"), F.expr("vec_id div 3 * 2")).alias("url"),
        "embedding",
        F.concat(F.lit("new"), v).alias("title"),
        v.alias("seq"),
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return upsert.upsert_vectors(current, inc).select(
        "url", "title", F.size("embedding").cast("long").alias("dim"),
        (F.floor(total * 10000 + 0.5) / 10000.0).alias("total"),
    )


@query(
    "W9_delete_date",
    "SELECT 'articles' AS tab, count(*) AS n FROM articles WHERE briefing_date <> DATE '2024-01-07' UNION ALL "
    "SELECT 'feedback', count(*) FROM feedback WHERE briefing_date <> DATE '2024-01-07' UNION ALL "
    "SELECT 'visited', count(*) FROM visited WHERE CAST(first_seen AS DATE) <> DATE '2024-01-07'",
    ["articles", "feedback", "visited"],
)
def w9(t):
    kept = upsert.delete_date(t.articles, t.feedback, t.visited, "2024-01-07")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        for name, df in zip(("articles", "feedback", "visited"), kept)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "W10_remove_failures",
    "SELECT url, phase, retry_count FROM failures_old WHERE url NOT IN (SELECT url FROM failures_new WHERE error_type='timeout')",
    ["failures_old", "failures_new"],
)
def w10(t):
    current, inc = failure_halves(t)
    resolved = inc.filter("error_type = 'timeout'").select("url").distinct()
    return upsert.remove_failures(current, resolved).select("url", "phase", "retry_count")


@query(
    "W12_stage_store",
    "SELECT 'deep_read' AS next_stage, lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY lang",
)
def w12(t):
    store = StageStore(t.spark, Scratch(t.spark, "stages").root, "run1")
    docs = t.documents.select("doc_id", "lang", "n_chars")
    store.write_stage("discover", entries=docs)
    store.write_stage("filter", entries=docs.filter("n_chars > 500"))
    store.write_stage("swap_to_reader")
    merged = StageStore(t.spark, store.base.rsplit("/run_id=", 1)[0], "run1")
    return (
        merged.load()["entries"]
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("next_stage", F.lit(merged.resume_from()))
    )


@query(
    "W13_add_bookmarks",
    ", i AS (SELECT briefing_date, article_number, collection_id, min(created_at) AS created_at FROM bm_in GROUP BY 1,2,3) "
    f"SELECT CAST(briefing_date AS VARCHAR) AS briefing_date, article_number, collection_id, {_STAMP.format('created_at')} AS created_at FROM "
    "(SELECT * FROM bm UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM bm b WHERE b.briefing_date=i.briefing_date "
    "AND b.article_number=i.article_number AND b.collection_id IS NOT DISTINCT FROM i.collection_id))",
    ["bm", "bm_in"],
)
def w13(t):
    held, inc = bookmark_tables(t)
    out = bookmarks.list_bookmarks(bookmarks.add_bookmarks(held, inc))
    return out.withColumns(
        {"created_at": stamp("created_at"), "briefing_date": F.col("briefing_date").cast("string")}
    )


@query(
    "W13_drop_collection",
    "SELECT CAST(b.briefing_date AS VARCHAR) AS briefing_date, b.article_number, CASE WHEN r_name IN ('ASIA','AFRICA') THEN NULL ELSE b.collection_id END AS collection_id "
    "FROM bm b LEFT JOIN region ON r_regionkey=b.collection_id WHERE NOT EXISTS (SELECT 1 FROM bm_in i WHERE "
    "i.briefing_date=b.briefing_date AND i.article_number=b.article_number)",
    ["bm", "bm_in"],
)
def w13b(t):
    held, inc = bookmark_tables(t)
    gone = collections(t).filter(F.col("name").isin("ASIA", "AFRICA"))
    _, freed = bookmarks.drop_collections(collections(t), held, gone)
    return bookmarks.remove_bookmarks(freed, inc).select(
        F.col("briefing_date").cast("string").alias("briefing_date"), "article_number", "collection_id"
    )


@query(
    "W15_reextract_bodies",
    f", {SQL_BODY}, x AS (SELECT 'p'||page_id AS k, page_id, CASE WHEN page_id%3=0 THEN 'x{{--a' WHEN page_id%3=1 THEN '' ELSE html END AS old, "
    "CASE WHEN page_id%4=0 THEN NULL WHEN page_id%4=1 THEN 'tiny' ELSE body END AS b, page_id%3<2 OR length(html)<100 AS broken FROM pages JOIN body USING (page_id)) "
    "SELECT k, md5(CASE WHEN broken AND length(b)>=100 THEN b ELSE old END) AS body FROM x UNION ALL "
    "SELECT 'updated='||count(*) FILTER (WHERE broken AND length(b)>=100)||' skipped='||count(*) FILTER (WHERE broken AND length(b)<100)||"
    "' failed='||count(*) FILTER (WHERE broken AND b IS NULL), NULL FROM x".replace(", d AS", "WITH d AS", 1),
)
def w15(t):
    p = F.col("page_id")
    arts = t.pages.select(
        F.lit("2024-01-01").cast("date").alias("briefing_date"),
        p.cast("int").alias("article_number"),
        F.concat(F.lit("p"), p).alias("url"),
        F.when(p % 3 == 0, "x{--a").when(p % 3 == 1, "").otherwise(F.col("html")).alias("body_content"),
        F.lit("html").alias("body_content_type"),
    )
    fetched = t.pages.filter(p % 4 != 0).select(
        F.concat(F.lit("p"), p).alias("url"),
        F.when(p % 4 == 1, "tiny").otherwise(F.col("html")).alias("html"),
    )
    nxt, counts = upsert.reextract_bodies(arts, fetched)
    line = counts.select(
        F.format_string("updated=%d skipped=%d failed=%d", "updated", "skipped", "failed").alias("k"),
        F.lit(None).cast("string").alias("body"),
    )
    return nxt.select(F.col("url").alias("k"), F.md5("body_content").alias("body")).unionByName(line)


@query(
    "F11_articles_by_date",
    "SELECT article_number, title FROM articles WHERE briefing_date = DATE '2024-01-05'",
    ["articles"],
)
def f11(t):
    return checks.articles_by_date(t.articles, "2024-01-05").select("article_number", "title")


@query(
    "F11_get_article",
    "SELECT title, md5(body_content) AS body FROM articles WHERE briefing_date = DATE '2024-01-05' AND article_number = 2",
    ["articles"],
)
def f11b(t):
    return checks.get_article(t.articles, "2024-01-05", 2).select(
        "title", F.md5("body_content").alias("body")
    )


@query(
    "F12_exists_in",
    "SELECT doc_id, url IN (SELECT url FROM visited) AS visited FROM (SELECT doc_id, 'doc:'||(doc_id*2) AS url FROM documents)",
    ["visited"],
)
def f12(t):
    keys = t.documents.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id") * 2).alias("url"))
    return checks.exists_in(keys, t.visited, ["url"], "visited").select("doc_id", "visited")
