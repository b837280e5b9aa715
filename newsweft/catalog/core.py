"""Registration of queries with their SQL counterparts, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = "2024-01-31 00:00:00"
GRAPH_NOW = "2002-01-01 00:00:00"
HISTORY_END = "1996-07-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def graph_now():
    return F.lit(GRAPH_NOW).cast("timestamp")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c):
    """A date as SQL writes it, whose years after 9999 have no sign and whose years before 1 are counted back."""
    before = F.format_string("%04d-%s (BC)", 1 - F.year(c), F.date_format(c, "MM-dd"))
    return F.when(F.year(c) > 0, F.ltrim(c.cast("string"), F.lit("+"))).when(c.isNotNull(), before)


class Tables:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        plain = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df

    @cached_property
    def documents(self):
        return self.read("documents")

    @cached_property
    def events(self):
        return self.read("events").withColumn(
            "k", F.get_json_object("props", "$.k").cast("int")
        )

    @cached_property
    def embeddings(self):
        return self.read("embeddings")

    @cached_property
    def pages(self):
        return self.read("pages")

    @cached_property
    def conversations(self):
        return self.read("conversations")

    @cached_property
    def entry(self):
        return self.documents.select(
            F.col("doc_id").alias("seq"),
            F.concat(F.lit("doc:"), "doc_id").alias("url"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("snippet"),
            F.col("source").alias("source_name"),
            F.col("doc_id").alias("feed_pos"),
        )

    @cached_property
    def scored(self):
        return self.entry.withColumn("score", ((F.col("seq") * 7919) % 11).cast("int"))

    @cached_property
    def visited(self):
        n = F.expr("event_id div 20")
        return (
            self.events.groupBy(n.alias("n"))
            .agg(
                F.max("ts").alias("first_seen"),
                F.bool_or(F.col("event_type") == "signup").alias("passed_relevance"),
                F.max(F.floor(F.col("value") / 50)).cast("int").alias("relevance_score"),
                F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias(
                    "was_briefed"
                ),
            )
            .select(
                F.concat(F.lit("doc:"), "n").alias("url"),
                F.concat(F.lit("t"), "n").alias("title"),
                F.concat(F.lit("src"), F.col("n") % 20).alias("source_name"),
                "first_seen",
                "passed_relevance",
                "relevance_score",
                "was_briefed",
            )
        )

    @cached_property
    def failures_in(self):
        k = F.col("k")
        return self.events.filter(F.col("event_type") == "error").select(
            F.concat(F.lit("u"), "user_id").alias("url"),
            F.element_at(
                F.array(*map(F.lit, ("filter", "fetch", "summarize", "novelty"))), k % 4 + 1
            ).alias("phase"),
            F.concat(F.lit("t"), "event_id").alias("title"),
            F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_name"),
            F.element_at(
                F.array(*map(F.lit, ("timeout", "parse_error", "http_error"))), k % 3 + 1
            ).alias("error_type"),
            F.concat(F.lit("k="), k).alias("error_message"),
            F.concat(F.lit("run"), F.dayofmonth("ts")).alias("run_id"),
            F.col("ts").alias("failed_at"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def articles(self):
        d = F.col("doc_id")
        g = (d * 37 % 101) / F.lit(100.0)
        return self.documents.select(
            F.date_add(F.lit("2024-01-01").cast("date"), (d % 30).cast("int")).alias("briefing_date"),
            (F.expr("doc_id div 30") + 1).cast("int").alias("article_number"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("source").alias("source_name"),
            F.concat(F.lit("doc:"), d).alias("url"),
            F.col("text").alias("summary"),
            F.concat(F.lit("insight "), F.col("n_chars")).alias("novel_insights"),
            F.array(
                "lang", F.concat(F.lit("Topic "), F.col("n_chars") % 50), F.col("source")
            ).alias("key_concepts"),
            F.array("lang", F.lit("news")).alias("related_topics"),
            ((d * 7919) % 11).cast("int").alias("relevance_score"),
            ((d * 71 % 101) / F.lit(100.0)).alias("novelty_score"),
            g.alias("graph_novelty"),
            ((d * 53 % 101) / F.lit(100.0)).alias("vector_novelty"),
            F.lit("").alias("novelty_explanation"),
            (d % 5 + 1).cast("int").alias("technical_depth"),
            (g < 0.4).alias("is_deepening"),
            F.col("text").alias("body_content"),
            F.lit("plaintext").alias("body_content_type"),
        )

    @cached_property
    def feedback_in(self):
        k = F.col("k")
        return self.events.select(
            F.to_date("ts").alias("briefing_date"),
            (F.col("user_id") % 40 + 1).cast("int").alias("article_number"),
            F.when(F.col("event_type").isin("view", "click"), True).alias("read"),
            F.when(F.col("event_type") == "click", k % 5 + 1).cast("int").alias("interest"),
            F.when(F.col("event_type") == "purchase", "like")
            .when(F.col("event_type") == "error", "broken")
            .alias("quality"),
            F.col("event_id").alias("seq"),
            F.col("ts").alias("processed_at"),
        )

    @cached_property
    def feedback(self):
        key = ["briefing_date", "article_number"]
        last = F.max_by(F.struct("read", "interest", "quality", "processed_at"), "seq")
        return (
            self.feedback_in.groupBy(*key)
            .agg(last.alias("f"))
            .select(
                *key,
                F.concat(F.lit("t"), "article_number").alias("title"),
                F.coalesce("f.read", F.lit(False)).alias("read"),
                "f.interest",
                "f.quality",
                "f.processed_at",
            )
        )

    @cached_property
    def runs(self):
        done = F.when(
            F.col("o_orderstatus") != "O",
            F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.col("o_orderdate")),
        )
        return self.read("orders").select(
            F.concat(F.lit("run"), "o_orderkey").alias("run_id"),
            F.col("o_orderdate").alias("started_at"),
            done.alias("completed_at"),
            F.col("o_custkey").alias("articles_scanned"),
            (F.col("o_custkey") % 50).alias("articles_relevant"),
            (F.col("o_custkey") % 10).alias("articles_briefed"),
            (F.col("o_custkey") % 7).alias("new_concepts_added"),
        )

    @cached_property
    def sources(self):
        return self.documents.groupBy(F.col("source").alias("name")).agg(
            (F.min("doc_id") % 7 + 5).cast("int").alias("max_articles")
        )

    @cached_property
    def concept_occ(self):
        """Concepts of one article per order; ``history`` marks what the graph already holds."""
        part = self.read("part").select("p_partkey", "p_name")
        return (
            self.read("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat(F.lit("order:"), "l_orderkey").alias("url"),
                F.col("l_orderkey").alias("seq"),
                F.col("l_linenumber").alias("pos"),
                F.concat("p_name", F.lit(" s"), "l_suppkey").alias("raw_concept"),
                F.concat(F.regexp_replace("p_name", " ", ""), F.lit("s"), "l_suppkey").alias(
                    "concept"
                ),
                F.col("l_shipdate").alias("seen_at"),
                F.col("l_returnflag").alias("flag"),
                (F.col("l_shipdate") < F.lit(HISTORY_END).cast("timestamp")).alias("history"),
            )
        )

    @cached_property
    def sparse_rows(self):
        """Every order line as an edge; lines of one tag meet on few ends, so there are cycles,
        bridges and several components to a tag."""
        tag = F.col("l_orderkey") % 997
        return self.read("lineitem").select(
            F.concat(F.lit("p"), tag, F.lit("n"), F.col("l_partkey") % 23).alias("a"),
            F.concat(F.lit("s"), tag, F.lit("n"), F.col("l_suppkey") % 19).alias("b"),
            F.col("l_shipdate").alias("seen_at"),
            F.col("l_orderkey").alias("ord"),
        )

    @cached_property
    def sparse_edges(self):
        return self.sparse_rows.groupBy("a", "b").agg(
            F.lit("co_occurrence").alias("relationship_type"),
            F.min("seen_at").alias("first_seen"),
        )

    @cached_property
    def sparse_nodes(self):
        ends = self.sparse_rows.select(
            F.explode(F.array("a", "b")).alias("concept"), "seen_at", "ord"
        )
        return ends.groupBy("concept").agg(
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
            F.count(F.lit(1)).alias("encounter_count"),
            ((F.max("ord") % 60) / F.lit(100.0)).alias("familiarity"),
        )

    @cached_property
    def event_nodes(self):
        """Concepts seen in the first half of the events."""
        return (
            self.events.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
            .groupBy(F.concat(F.lit("user"), F.col("user_id"), F.lit("x")).alias("concept"))
            .agg(
                F.min("ts").alias("first_seen"),
                F.max("ts").alias("last_seen"),
                F.count(F.lit(1)).alias("encounter_count"),
                ((F.max("event_id") * 13 % 101) / F.lit(100.0)).alias("familiarity"),
            )
        )


VIEW_SQL = {
    "ev": "SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events",
    "entry": (
        "SELECT doc_id AS seq, 'doc:'||doc_id AS url, split_part(text, chr(10), 1) AS title, "
        "text AS snippet, source AS source_name, doc_id AS feed_pos, text "
        "FROM documents"
    ),
    "scored": "SELECT *, CAST((seq*7919)%11 AS INTEGER) AS score FROM entry",
    "visited": (
        "SELECT 'doc:'||(event_id//20) AS url, 't'||(event_id//20) AS title, "
        "'src'||((event_id//20)%20) AS source_name, max(ts) AS first_seen, "
        "bool_or(event_type='signup') AS passed_relevance, "
        "CAST(max(floor(value/50)) AS INTEGER) AS relevance_score, "
        "bool_or(event_type='purchase' AND value>50) AS was_briefed "
        "FROM events GROUP BY event_id//20"
    ),
    "failures_in": (
        "SELECT 'u'||user_id AS url, (['filter','fetch','summarize','novelty'])[k%4+1] AS phase, "
        "'t'||event_id AS title, 'src'||(user_id%20) AS source_name, "
        "(['timeout','parse_error','http_error'])[k%3+1] AS error_type, 'k='||k AS error_message, "
        "'run'||day(ts) AS run_id, ts AS failed_at, event_id AS seq FROM ev WHERE event_type='error'"
    ),
    "articles": (
        "SELECT CAST(DATE '2024-01-01' + CAST(doc_id%30 AS INTEGER) AS DATE) AS briefing_date, "
        "CAST(doc_id//30+1 AS INTEGER) AS article_number, split_part(text,chr(10),1) AS title, "
        "source AS source_name, 'doc:'||doc_id AS url, text AS summary, "
        "'insight '||n_chars AS novel_insights, [lang, 'Topic '||(n_chars%50), source] AS key_concepts, "
        "[lang,'news'] AS related_topics, CAST((doc_id*7919)%11 AS INTEGER) AS relevance_score, "
        "(doc_id*71%101)/100.0::DOUBLE AS novelty_score, (doc_id*37%101)/100.0::DOUBLE AS graph_novelty, "
        "(doc_id*53%101)/100.0::DOUBLE AS vector_novelty, CAST(doc_id%5+1 AS INTEGER) AS technical_depth, "
        "(doc_id*37%101)/100.0::DOUBLE < 0.4 AS is_deepening, text AS body_content, "
        "'plaintext' AS body_content_type FROM documents"
    ),
    "feedback_in": (
        "SELECT CAST(ts AS DATE) AS briefing_date, CAST(user_id%40+1 AS INTEGER) AS article_number, "
        "CASE WHEN event_type IN ('view','click') THEN true END AS read, "
        "CASE WHEN event_type='click' THEN k%5+1 END AS interest, "
        "CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'broken' END AS quality, "
        "event_id AS seq, ts AS processed_at FROM ev"
    ),
    "feedback": (
        "SELECT briefing_date, article_number, 't'||article_number AS title, "
        "coalesce(read,false) AS read, interest, quality, processed_at FROM feedback_in "
        "QUALIFY row_number() OVER (PARTITION BY briefing_date, article_number ORDER BY seq DESC)=1"
    ),
    "runs": (
        "SELECT 'run'||o_orderkey AS run_id, o_orderdate AS started_at, "
        "CASE WHEN o_orderstatus<>'O' THEN o_orderdate + to_seconds(o_orderkey) END AS completed_at, "
        "o_custkey AS articles_scanned, o_custkey%50 AS articles_relevant, "
        "o_custkey%10 AS articles_briefed, o_custkey%7 AS new_concepts_added FROM orders"
    ),
    "sources": (
        "SELECT source AS name, CAST(min(doc_id)%7+5 AS INTEGER) AS max_articles "
        "FROM documents GROUP BY source"
    ),
    "concept_occ": (
        "SELECT 'order:'||l_orderkey AS url, l_orderkey AS seq, l_linenumber AS pos, "
        "p_name||' s'||l_suppkey AS raw_concept, replace(p_name,' ','')||'s'||l_suppkey AS concept, "
        "l_shipdate AS seen_at, l_returnflag AS flag, "
        f"l_shipdate < TIMESTAMP '{HISTORY_END}' AS history "
        "FROM lineitem JOIN part ON l_partkey=p_partkey"
    ),
    "sparse_rows": (
        "SELECT 'p'||(l_orderkey%997)||'n'||(l_partkey%23) AS a, 's'||(l_orderkey%997)||'n'||(l_suppkey%19) AS b, "
        "l_shipdate AS seen_at, l_orderkey AS ord FROM lineitem"
    ),
    "sparse_edges": "SELECT a, b, min(seen_at) AS first_seen FROM sparse_rows GROUP BY a, b",
    "sparse_nodes": (
        "SELECT concept, min(seen_at) AS first_seen, max(seen_at) AS last_seen, "
        "count(*) AS encounter_count, (max(ord)%60)/100.0::DOUBLE AS familiarity FROM "
        "(SELECT a AS concept, seen_at, ord FROM sparse_rows UNION ALL "
        "SELECT b, seen_at, ord FROM sparse_rows) GROUP BY concept"
    ),
    "event_nodes": (
        "SELECT 'user'||user_id||'x' AS concept, min(ts) AS first_seen, max(ts) AS last_seen, "
        "count(*) AS encounter_count, (max(event_id)*13%101)/100.0::DOUBLE AS familiarity "
        "FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id"
    ),
}
_DEPENDS = {
    "scored": ["entry"],
    "failures_in": ["ev"],
    "feedback_in": ["ev"],
    "feedback": ["feedback_in"],
    "sparse_edges": ["sparse_rows"],
    "sparse_nodes": ["sparse_rows"],
}


def with_views(uses: list[str], body: str) -> str:
    """Prefix ``body`` with the views it uses; ``body`` may open with more CTEs after a comma."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in _DEPENDS.get(name, []):
            visit(d)
        if name not in order:
            order.append(name)

    for u in uses:
        visit(u)
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    if not ctes:
        return body
    body = body.strip()
    if body.startswith("RECURSIVE"):
        return f"WITH RECURSIVE {ctes}{body.removeprefix('RECURSIVE')}"
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None, uses: list[str] | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name``; without ``sql`` only rows are checked."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(uses or [], sql)
        return fn

    return register


# SQL fragments that several counterparts share.
SQL_WS = (
    r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^[{SQL_WS}]+|[{SQL_WS}]+\z', '', 'g')"


def sql_strip_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', '', 'g')"


def sql_drop_elements(e: str) -> str:
    for tag in ("style", "script", "noscript", "svg", "head"):
        e = rf"regexp_replace({e}, '(?is)<{tag}[\s>].*?</{tag}>', '', 'g')"
    return e


def sql_clean(e: str) -> str:
    breaks = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return (
        f"array_to_string(list_filter(list_transform(regexp_split_to_array({e}, '{breaks}'), "
        f"lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10))"
    )


def sql_round(e: str, digits: int) -> str:
    scale = float(10**digits)
    return f"floor(({e})*{scale}+0.5)/{scale}"
