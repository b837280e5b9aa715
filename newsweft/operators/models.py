"""Where user models plug in, and a deterministic built-in for each place.

A model is any Column function, in practice a pandas UDF over Arrow batches. The built-ins need no
model: plain Column expressions, and for embeddings hashed word counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions.text import chunk_text, embed_text, estimate_tokens, let, strip
from newsweft.lineage import Scratch
from newsweft.operators.checks import failure_columns
from newsweft.operators.graph import graph_context, question_words, related_concepts, word_hits
from newsweft.operators.skew import top_per_group
from newsweft.operators.vectors import knn_cosine
from newsweft.params import Params

# Fixed value: the answer when nothing is stored yet.
NOTHING_STORED = (
    "No relevant articles found in your knowledge base yet. "
    "Run the pipeline first to build up your knowledge."
)


@dataclass(frozen=True)
class Interests:
    primary: list[str]
    secondary: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def _hits(text: Column, terms: list[str]) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + F.contains(text, F.lit(term.lower())).cast("int")
    return out


def term_scorer(interests: Interests) -> Callable[[Column], Column]:
    """Three points per primary term, one per secondary, none when an excluded term occurs."""

    def score(text: Column) -> Column:
        def rate(t: Column) -> Column:
            p, s = _hits(t, interests.primary), _hits(t, interests.secondary)
            barred = _hits(t, interests.excluded) > 0
            points = F.when(barred, F.lit(0)).otherwise(F.least(F.lit(10), 3 * p + s))
            why = F.when(barred, F.lit("excluded term")).otherwise(
                F.format_string("%d primary, %d secondary terms", p, s)
            )
            return F.struct(points.alias("score"), why.alias("justification"))

        return let(F.lower(text), rate)

    return score


def entry_text() -> Column:
    return F.concat("title", F.lit("\n"), F.coalesce("snippet", F.lit("")))


def score_relevance(
    entries: DataFrame, interests: Interests, scorer: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scored entries, and failure rows for those the scorer gave no usable answer.

    ``scorer`` maps the text to ``struct<score int, justification string>``.
    """
    score = (scorer or term_scorer(interests))(entry_text())
    rated = entries.withColumn("r", score)
    good = F.coalesce(F.col("r.score").between(0, 10), F.lit(False)) & F.col(
        "r.justification"
    ).isNotNull()
    flagged = rated.withColumn("ok", good)
    scored = flagged.filter("ok").select(
        *entries.columns, F.col("r.score").cast("int").alias("score"), "r.justification"
    ) if "score" not in entries.columns else flagged.filter("ok").select(
        *[c for c in entries.columns if c != "score"],
        F.col("r.score").cast("int").alias("score"), "r.justification",
    )
    failed = flagged.filter(~F.col("ok")).select(
        "url", "title", "source_name",
        *failure_columns("filter", "parse_error", F.lit("No usable relevance score")),
    )
    return scored, failed


def hashed_embedder(dim: int = 256) -> Callable[[Column], Column]:
    """Counts of words by the bucket of their md5, scaled to unit length. Nothing is fitted, so texts
    of different runs can be compared. A text without words is the zero vector."""

    @F.pandas_udf("array<float>")
    def embedded(words: pd.Series) -> pd.Series:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            if word not in buckets:
                if len(buckets) > 200_000:
                    buckets.clear()
                buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            return buckets[word]

        def one(ws) -> np.ndarray:
            counts = np.bincount([bucket(w) for w in ws], minlength=dim) if len(ws) else np.zeros(dim)
            norm = np.sqrt(float((counts * counts).sum()))
            return (counts / norm if norm else counts).astype(np.float32)

        return words.map(one)

    return lambda text: embedded(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def embed(
    summaries: DataFrame, embedder: Callable[[Column], Column] | None = None, *, dim: int = 256
) -> DataFrame:
    """Add ``text`` and its ``embedding`` to summaries."""
    df = summaries.withColumn("text", embed_text(F.col("key_concepts"), F.col("summary")))
    embedder = embedder or hashed_embedder(dim)
    return df.withColumn("embedding", embedder(F.coalesce("text", F.lit(""))).cast("array<float>"))


def _sentences(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def leading_sentences(n: int) -> Callable[[Column], Column]:
    return lambda text: F.array_join(F.slice(_sentences(text), 1, n), " ")


def rare_terms(bodies: DataFrame, n: int = 8) -> DataFrame:
    """``(url, key_concepts)``: the ``n`` terms of each body that fewest bodies share."""
    words = F.filter(
        F.array_distinct(F.split(F.lower("body"), r"[^\p{L}\p{N}]+")), lambda x: F.length(x) > 3
    )
    terms = bodies.select("url", F.explode(words).alias("term"))
    share = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    best = top_per_group(
        terms.join(share, "term"), ["url"], [F.col("df"), F.col("term")], n
    )
    listed = F.array_sort(F.collect_list(F.struct("df", "term")))
    return best.groupBy("url").agg(F.transform(listed, lambda x: x["term"]).alias("key_concepts"))


def merge_parts(
    bodies: DataFrame, params: Params, chunk_summarizer: Callable[[Column], Column], separator: str
) -> DataFrame:
    """Bodies short enough to read at once as they are, longer ones as their part summaries."""
    long_ = estimate_tokens(F.col("body")) > params.max_chunk_tokens
    parts = (
        bodies.filter(long_)
        .select(
            "url",
            F.posexplode(
                chunk_text(F.col("body"), params.max_chunk_tokens, separator=separator)
            ).alias("i", "chunk"),
        )
        .select("url", "i", strip(chunk_summarizer(F.col("chunk"))).alias("part"))
        .filter(F.col("part") != "")
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "part")))
    merged = parts.groupBy("url").agg(
        F.array_join(
            F.transform(
                ordered, lambda x, i: F.concat(F.lit("[Part "), i + 1, F.lit("] "), x["part"])
            ),
            "\n\n",
        ).alias("to_read")
    )
    short = bodies.filter(~long_).select("url", F.col("body").alias("to_read"))
    return short.unionByName(merged)


def summarize(
    bodies: DataFrame,
    params: Params,
    now: Column,
    *,
    chunk_summarizer: Callable[[Column], Column] | None = None,
    summarizer: Callable[[Column], Column] | None = None,
    separator: str = "\n\n",
) -> DataFrame:
    """Summary rows of ``bodies(url, seq, title, source_name, body)``.

    ``summarizer`` maps the text to ``struct<key_concepts, summary, novel_insights,
    technical_depth, related_topics, relationships>``; bodies it returns NULL for are left out.
    """
    parts = merge_parts(bodies, params, chunk_summarizer or leading_sentences(3), separator)
    read = bodies.join(parts, "url")
    kept = ["url", "seq", "title", "source_name"]
    fixed = [
        now.alias("date_processed"),
        F.col("body").alias("body_content"),
        F.lit("plaintext").alias("body_content_type"),
    ]
    if summarizer is not None:
        return (
            read.withColumn("s", summarizer(F.col("to_read")))
            .filter("s is not null")
            .select(*kept, "s.*", *fixed)
        )
    none = F.array().cast("array<struct<`from`:string,`to`:string,type:string>>")
    sentences = _sentences(F.col("to_read"))
    return read.join(rare_terms(bodies), "url", "left").select(
        *kept,
        F.coalesce("key_concepts", F.array().cast("array<string>")).alias("key_concepts"),
        leading_sentences(3)(F.col("to_read")).alias("summary"),
        F.coalesce(F.get(sentences, F.size(sentences) - 1), F.lit("")).alias("novel_insights"),
        F.least(F.lit(5), F.lit(1) + F.floor(F.length("body") / 2000)).cast("int").alias("technical_depth"),
        F.array("source_name").alias("related_topics"),
        none.alias("relationships"),
        *fixed,
    )


def retrieve_context(
    questions: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10
) -> DataFrame:
    """Per question: the ``k`` closest articles as numbered snippets, and what the graph knows.

    ``questions``: question_id, question, embedding. ``vectors``: url, embedding, title, source,
    document.
    """
    near = knn_cosine(
        questions.select(F.col("question_id").cast("string").alias("url"), "embedding"), vectors, k
    )
    found = near.join(vectors.drop("embedding"), "url").select(
        F.col("query").alias("qid"),
        "rank",
        F.struct(
            F.col("rank"), "title", "url", "source",
            (F.floor(F.col("similarity") * 1000 + 0.5) / 1000.0).alias("similarity"),
        ).alias("article"),
        F.format_string(
            '[Article %d] "%s" (similarity: %.2f)\n%s', "rank",
            F.coalesce("title", F.lit("Unknown")), "similarity", F.coalesce("document", F.lit("")),
        ).alias("snippet"),
    )
    # both looks at the graph read its nodes and the words' hits from one table
    scratch = Scratch(questions.sparkSession, "retrieval")
    nodes = scratch.put(nodes.select("concept", "first_seen", "encounter_count", "familiarity"))
    hits = scratch.put(word_hits(question_words(questions), nodes))
    # at most k rows per question
    ordered = F.array_sort(F.collect_list(F.struct("rank", "snippet", "article")))
    per_question = found.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda x: x["snippet"]), "\n\n").alias("articles"),
        F.transform(ordered, lambda x: x["article"]).alias("sources"),
    )
    related = related_concepts(questions, nodes, edges, 15, hits=hits).groupBy("question_id").agg(
        F.array_sort(F.collect_list("concept")).alias("related_concepts")
    )
    text = F.concat(
        "articles",
        F.when(
            F.coalesce("graph_context", F.lit("")) != "",
            F.concat(
                F.lit("\n\n--- KNOWLEDGE GRAPH CONTEXT ---\n"), "graph_context",
                F.lit("\n--- END GRAPH ---"),
            ),
        ).otherwise(F.lit("")),
    )
    none = F.array().cast("array<string>")
    has = F.col("articles").isNotNull()
    return (
        questions.drop("embedding")
        .withColumn("qid", F.col("question_id").cast("string"))
        .join(per_question, "qid", "left")
        .join(graph_context(questions, nodes, edges, hits=hits), "question_id", "left")
        .join(related, "question_id", "left")
        .select(
            "question_id",
            "question",
            F.when(has, text).otherwise(F.lit(NOTHING_STORED)).alias("context"),
            F.coalesce("graph_context", F.lit("")).alias("graph_context"),
            F.when(has, F.coalesce("related_concepts", none)).otherwise(none).alias("related_concepts"),
            "sources",
        )
    )


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions for use in ``FROM t, LATERAL f(...)``.

    ``nw_chunk_text(text, max_tokens)`` and ``nw_html_links(html)`` return positions and values.
    """
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION nw_chunk_text(body STRING, max_tokens INT)
        RETURNS TABLE (pos INT, chunk STRING)
        RETURN SELECT s.pos, array_join(slice(p, s.`from` + 1, coalesce(get(starts, s.pos + 1), size(p)) - s.`from`), '\n\n')
        FROM (SELECT p, CASE WHEN length(body) div 4 <= max_tokens THEN array(0) ELSE
                aggregate(p, struct(array(0) AS at, 0 AS n, 0 AS i),
                  (acc, x) -> struct(
                    IF(acc.n + length(x) > max_tokens * 4 AND acc.i > element_at(acc.at, -1),
                       concat(acc.at, array(acc.i)), acc.at) AS at,
                    IF(acc.n + length(x) > max_tokens * 4 AND acc.i > element_at(acc.at, -1),
                       length(x), acc.n + length(x)) AS n,
                    acc.i + 1 AS i)).at END AS starts
              FROM (SELECT split(body, '\n\n') AS p)) t
        LATERAL VIEW posexplode(starts) s AS pos, `from`
        """
    )
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION nw_html_links(html STRING)
        RETURNS TABLE (pos INT, href STRING, title STRING)
        RETURN SELECT e.pos, trim(get(hrefs, e.pos)), trim(regexp_replace(e.inner_html, '<[^>]+>', ''))
        FROM (SELECT
                regexp_extract_all(html, r'(?is)<a\s[^>]*href=["\x27]([^"\x27]+)["\x27][^>]*>(.*?)</a>', 1) AS hrefs,
                regexp_extract_all(html, r'(?is)<a\s[^>]*href=["\x27]([^"\x27]+)["\x27][^>]*>(.*?)</a>', 2) AS inners) t
        LATERAL VIEW posexplode(inners) e AS pos, inner_html
        """
    )
