"""Dedup, quotas, ranking and reports over documents, events and orders."""

from dataclasses import replace

from pyspark.sql import functions as F

from newsweft.catalog.core import VIEW_SQL, _DEPENDS, now, query, stamp
from newsweft.operators import checks, select, stats
from newsweft.params import Params

# thirty days of events cannot outlive the default window for briefed urls
PARAMS = replace(Params(), briefed_dedup_days=20)

VIEW_SQL["new_entry"] = (
    "SELECT * FROM entry e WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.url=e.url AND "
    "((coalesce(was_briefed,false) AND first_seen > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY) OR "
    "(NOT coalesce(was_briefed,false) AND first_seen > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)))"
)
_DEPENDS["new_entry"] = ["entry", "visited"]
VIEW_SQL["new_scored"] = "SELECT *, CAST((seq*7919)%11 AS INTEGER) AS score, (seq*7919)%11 >= 6 AS passed FROM new_entry"
_DEPENDS["new_scored"] = ["new_entry"]
VIEW_SQL["nov"] = (
    "SELECT 'doc:'||doc_id AS url, doc_id AS seq, (doc_id*53%101)/100.0::DOUBLE <= 0.15 AS is_near_duplicate, "
    "(doc_id*71%101)/100.0::DOUBLE AS final_score FROM documents"
)


def new_entry(t):
    return select.filter_new(t.entry, t.visited, now(), PARAMS)


def new_scored(t):
    scored = new_entry(t).withColumn("score", ((F.col("seq") * 7919) % 11).cast("int"))
    return select.split_relevance(scored, select.adaptive_threshold(scored, PARAMS))


def novelty(t):
    return t.articles.select(
        "url",
        F.regexp_extract("url", r"\d+", 0).cast("long").alias("seq"),
        (F.col("vector_novelty") <= 0.15).alias("is_near_duplicate"),
        F.col("novelty_score").alias("final_score"),
        "vector_novelty", "graph_novelty", "novelty_score", "relevance_score",
    )


@query("J1_filter_new", "SELECT url FROM new_entry", ["new_entry"])
def j1(t):
    return new_entry(t).select("url")


@query(
    "O2_url_difference",
    "SELECT DISTINCT url FROM visited WHERE url NOT IN (SELECT url FROM entry WHERE length(snippet) < 400)",
    ["visited", "entry"],
)
def o2(t):
    return select.url_difference(t.visited, t.entry.filter(F.length("snippet") < 400))


@query(
    "F5_adaptive_threshold",
    ", p AS (SELECT source_name, count(*) AS pool FROM new_entry GROUP BY 1) "
    "SELECT count(*) AS pool, CAST(CASE WHEN count(*) < 10 THEN 4 WHEN count(*) < 15 THEN 5 ELSE 6 END AS INTEGER) AS threshold FROM new_entry",
    ["new_entry"],
)
def f5(t):
    return select.adaptive_threshold(new_entry(t), PARAMS)


@query("F6_split_relevance", "SELECT url, score, passed FROM new_scored", ["new_scored"])
def f6(t):
    return new_scored(t).select("url", "score", "passed")


@query(
    "F6_no_filter",
    "SELECT url, CAST(10 AS INTEGER) AS score, true AS passed FROM new_entry",
    ["new_entry"],
)
def f6b(t):
    return select.no_filter(new_entry(t)).select("url", "score", "passed")


@query(
    "F7_drop_near_duplicates",
    "SELECT url FROM articles WHERE vector_novelty > 0.15",
    ["articles"],
)
def f7(t):
    return select.drop_near_duplicates(novelty(t)).select("url")


_ROLES = (
    ", n AS (SELECT least(greatest(count(*) FILTER (WHERE passed), 5), 10) AS n FROM new_scored), "
    "r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS rank FROM new_scored), "
    "q AS (SELECT url, seq, score, rank, CASE WHEN rank <= n THEN 'passed' ELSE 'reserve' END AS role "
    "FROM r, n WHERE rank <= n + 5) "
)


@query("R1_quota_select", _ROLES + "SELECT url, score, rank, role FROM q", ["new_scored"])
def r1(t):
    return select.quota_select(new_scored(t), PARAMS).select("url", "score", "rank", "role")


def reading(t):
    roles = select.quota_select(new_scored(t), PARAMS)
    passed = roles.filter("role = 'passed'")
    reserve = roles.filter("role = 'reserve'")
    return passed, reserve, passed.filter("seq % 3 = 0")


@query(
    "R2_reader_backfill",
    _ROLES + ", s AS (SELECT count(*) AS k FROM q WHERE role='passed' AND seq%3=0), f AS (SELECT min(rank) AS f FROM q WHERE role='reserve') "
    "SELECT url, rank FROM q, s, f WHERE role='reserve' AND 5-k > 0 AND rank - f < 5-k+2",
    ["new_scored"],
)
def r2(t):
    passed, reserve, summaries = reading(t)
    return select.reader_backfill(summaries, reserve, PARAMS).select("url", "rank")


@query(
    "J12_reserve_used",
    _ROLES + "SELECT url, role FROM q WHERE role='passed' OR seq%2=0",
    ["new_scored"],
)
def j12(t):
    passed, reserve, _ = reading(t)
    read = reserve.filter("seq % 2 = 0")
    return select.extend_passed(passed, reserve, read).select("url", "role")


@query(
    "R3_novelty_select",
    ", c AS (SELECT count(*) FILTER (WHERE NOT is_near_duplicate) AS n FROM nov), d AS (SELECT *, row_number() OVER "
    "(PARTITION BY is_near_duplicate ORDER BY final_score DESC, seq) AS rn FROM nov) "
    "SELECT url, final_score FROM d, c WHERE NOT is_near_duplicate OR rn <= 5 - n",
    ["nov"],
)
def r3(t):
    rows = t.entry.select("url", "seq", "title")
    return select.novelty_select(rows, novelty(t), PARAMS).select("url", "final_score")


@query(
    "R3_backfill_duplicates",
    "SELECT url FROM nov WHERE is_near_duplicate ORDER BY final_score DESC, seq LIMIT 5",
    ["nov"],
)
def r3b(t):
    dups = novelty(t).filter("is_near_duplicate")
    rows = t.entry.select("url", "seq").join(dups.select("url"), "url", "left_semi")
    return select.novelty_select(rows, dups, PARAMS).select("url")


@query(
    "R4_rank_by_final",
    "SELECT url, final_score FROM nov ORDER BY final_score DESC, seq",
    ["nov"],
)
def r4(t):
    return select.rank_by_final(novelty(t)).select("url", "final_score")


def ranked(t):
    return t.articles.select(
        "briefing_date", "url", "is_deepening",
        (-F.col("novelty_score")).alias("s"),
        F.regexp_extract("url", r"\d+", 0).cast("long").alias("seq"),
    ).withColumn("rank", F.struct("s", "seq")).drop("s", "seq")


_RANKED = (
    "SELECT CAST(briefing_date AS VARCHAR) AS briefing_date, url, CAST(row_number() OVER (PARTITION BY briefing_date "
    "ORDER BY {}novelty_score DESC, CAST(regexp_extract(url, '\\d+') AS BIGINT)) AS INTEGER) AS article_number FROM articles"
)


def numbered(df):
    return df.select(F.col("briefing_date").cast("string").alias("briefing_date"), "url", "article_number")


@query("R5_number_articles", _RANKED.format(""), ["articles"])
def r5(t):
    return numbered(select.number_articles(ranked(t)))


@query("R6_number_briefing", _RANKED.format("is_deepening, "), ["articles"])
def r6(t):
    return numbered(select.number_briefing(ranked(t)))


@query(
    "R7_first_by_url",
    "SELECT md5(text) AS url, min(doc_id) AS seq FROM documents GROUP BY text",
)
def r7(t):
    rows = t.documents.select(F.md5("text").alias("url"), F.col("doc_id").alias("seq"))
    return select.first_by_url(rows)


@query(
    "J2_unscored_as_failed",
    "SELECT url, CASE WHEN length(title)%4=0 THEN false ELSE passed END AS passed_relevance, "
    "CASE WHEN length(title)%4>0 THEN score END AS relevance_score FROM new_scored",
    ["new_scored"],
)
def j2(t):
    scored = new_scored(t).filter(F.length("title") % 4 > 0)
    return select.visited_rows(new_entry(t), scored).select(
        "url", "passed_relevance", "relevance_score"
    )


@query(
    "J3_assemble_articles",
    "SELECT 'doc:'||doc_id AS url, coalesce(CAST(quality*5 AS INTEGER), 0) AS relevance_score, "
    "CASE WHEN doc_id%3>0 THEN (doc_id*71%101)/100.0::DOUBLE ELSE 0.0::DOUBLE END AS novelty_score, "
    "doc_id%3>0 AND (doc_id*37%101)/100.0::DOUBLE < 0.4 AS is_deepening FROM documents LEFT JOIN labels USING (doc_id)",
)
def j3(t):
    rel = t.read("labels").select(
        F.concat(F.lit("doc:"), "doc_id").alias("url"),
        (F.col("quality") * 5).cast("int").alias("relevance_score"),
    )
    known = novelty(t).filter("seq % 3 > 0")
    return select.assemble_articles(t.entry.select("url", "title"), known, rel).select(
        "url", "relevance_score", "novelty_score", "is_deepening"
    )


@query(
    "A13_run_funnel",
    _ROLES + "SELECT (SELECT count(*) FROM entry) AS scanned, (SELECT count(*) FROM new_entry) AS new, "
    "(SELECT count(*) FROM q WHERE role='passed') AS passed, CAST(0 AS BIGINT) AS summarised, "
    "'All article reads/summaries failed' AS stop_reason",
    ["new_scored"],
)
def a13(t):
    passed, _, _ = reading(t)
    return stats.run_funnel(t.entry, new_entry(t), passed, passed.filter("score > 10"), PARAMS)


@query(
    "A1_url_stats",
    "SELECT count(*) AS total_urls, count(*) FILTER (WHERE passed_relevance) AS passed_relevance, "
    "count(DISTINCT source_name) AS sources FROM visited",
    ["visited"],
)
def a1(t):
    return stats.url_stats(t.visited)


@query(
    "A2_briefing_dates",
    "SELECT CAST(briefing_date AS VARCHAR) AS briefing_date, count(*) AS article_count FROM articles GROUP BY 1",
    ["articles"],
)
def a2(t):
    return stats.briefing_dates(t.articles).withColumn(
        "briefing_date", F.col("briefing_date").cast("string")
    )


@query(
    "A3_failure_stats",
    "SELECT CASE WHEN grouping(phase)=1 AND grouping(error_type)=1 THEN 'total' WHEN grouping(phase)=0 THEN 'phase' "
    "ELSE 'error_type' END AS scope, coalesce(phase, error_type, '') AS value, count(*) AS n FROM failures_in "
    "GROUP BY GROUPING SETS ((), (phase), (error_type))",
    ["failures_in"],
)
def a3(t):
    return stats.failure_stats(t.failures_in)


@query(
    "A14_failure_breakdown",
    "SELECT CAST(sum(n) AS BIGINT) AS failures, string_agg(phase||': '||n, ', ' ORDER BY phase) AS breakdown FROM "
    "(SELECT phase, count(*) AS n FROM failures_in GROUP BY phase)",
    ["failures_in"],
)
def a14(t):
    return stats.failure_breakdown(t.failures_in)


@query(
    "A18_briefing_chart",
    ", c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30) "
    "SELECT CAST(d AS VARCHAR) AS briefing_date, n AS article_count, greatest(n/max(n) OVER ()*100, 2.0)::DOUBLE AS height_pct FROM c".replace(", c AS", "WITH c AS", 1),
)
def a18(t):
    orders = t.read("orders").select(F.to_date("o_orderdate").alias("briefing_date"))
    return stats.briefing_chart(orders).withColumn(
        "briefing_date", F.col("briefing_date").cast("string")
    )


@query(
    "J11_briefing_list",
    ", f AS (SELECT briefing_date, count(*) FILTER (WHERE read) AS r FROM feedback WHERE day(briefing_date)%4>0 GROUP BY 1), "
    "a AS (SELECT briefing_date, count(*) AS n FROM articles GROUP BY 1) "
    "SELECT CAST(a.briefing_date AS VARCHAR) AS briefing_date, n AS article_count, f.briefing_date IS NOT NULL AS has_feedback, "
    "coalesce(r,0) AS read_count FROM a LEFT JOIN f USING (briefing_date)",
    ["articles", "feedback"],
)
def j11(t):
    fb = t.feedback.filter(F.dayofmonth("briefing_date") % 4 > 0)
    return stats.briefing_list(t.articles, fb).withColumn(
        "briefing_date", F.col("briefing_date").cast("string")
    )


@query(
    "R10_recent_runs",
    "SELECT run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 10",
    ["runs"],
)
def r10(t):
    return stats.recent_runs(t.runs).select("run_id", stamp("started_at").alias("started_at"))


@query(
    "R10_last_run",
    "SELECT run_id FROM runs WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, run_id DESC LIMIT 1",
    ["runs"],
)
def r10b(t):
    return stats.last_run(t.runs).select("run_id")


@query(
    "R11_pick_briefing",
    ", b AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) "
    "SELECT 'latest' AS key, CAST(d AS VARCHAR) AS briefing_date, n FROM b WHERE d=(SELECT max(d) FROM b) UNION ALL "
    "SELECT 'yesterday', CAST(d AS VARCHAR), n FROM b WHERE d = DATE '2024-01-19' UNION ALL "
    "SELECT 'literal', CAST(d AS VARCHAR), n FROM b WHERE d = DATE '2024-01-03'".replace(", b AS", "WITH b AS", 1),
)
def r11(t):
    days = t.events.groupBy(F.to_date("ts").alias("briefing_date")).agg(F.count(F.lit(1)).alias("n"))
    picks = [("latest", "latest"), ("yesterday", "yesterday"), ("literal", "2024-01-03")]
    out = None
    for name, key in picks:
        one = stats.pick_briefing(days, key, "2024-01-20").select(
            F.lit(name).alias("key"), F.col("briefing_date").cast("string").alias("briefing_date"), "n"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "O1_compare_briefings",
    ", c AS (SELECT briefing_date AS d, lower(unnest(key_concepts)) AS concept FROM articles) "
    "SELECT concept, CASE WHEN bool_or(d=DATE '2024-01-03') AND bool_or(d=DATE '2024-01-04') THEN 'shared' "
    "WHEN bool_or(d=DATE '2024-01-03') THEN 'only_left' ELSE 'only_right' END AS side FROM c "
    "WHERE d IN (DATE '2024-01-03', DATE '2024-01-04') GROUP BY concept",
    ["articles"],
)
def o1(t):
    return stats.compare_briefings(t.articles, "2024-01-03", "2024-01-04")


@query(
    "P1_todays_articles",
    r", k AS (SELECT * FROM new_entry WHERE NOT regexp_matches(title || snippet, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')), "
    "s AS (SELECT *, CAST((seq*7919)%11 AS INTEGER) AS score FROM k QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq)=1), "
    "c AS (SELECT CASE WHEN count(*)<10 THEN 4 WHEN count(*)<15 THEN 5 ELSE 6 END AS thr FROM s), "
    "n AS (SELECT least(greatest(count(*) FILTER (WHERE score>=thr),5),10) AS n FROM s, c) "
    "SELECT url, title, score, CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS article_number FROM s, n "
    "QUALIFY row_number() OVER (ORDER BY score DESC, seq) <= any_value(n.n) OVER ()",
    ["new_entry"],
)
def todays_articles(t):
    """The unseen documents that make up the day's briefing."""
    fresh = select.new_articles_today(t.entry, t.visited, now(), PARAMS)
    scored = fresh.withColumn("score", ((F.col("seq") * 7919) % 11).cast("int"))
    passed = select.split_relevance(scored, select.adaptive_threshold(fresh, PARAMS))
    roles = select.quota_select(passed, PARAMS).filter("role = 'passed'")
    return roles.select("url", "title", "score", F.col("rank").alias("article_number"))
