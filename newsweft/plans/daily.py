"""A whole run over tables: from landed payloads to the day's briefing and the next state.

A run is a list of stages. Each is planned from the inputs and from what earlier stages have written,
and writes its own tables; a stage that is marked as finished is loaded and not planned again, so a
broken run goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions.text import extract_body, usable_html
from newsweft.lineage import Scratch
from newsweft.operators import (
    briefing,
    checks,
    components,
    feedback,
    graph,
    models,
    select,
    stats,
    upsert,
    vectors,
)
from newsweft.params import Params
from newsweft.plans.staging import STAGES, StageStore
from newsweft.sources.registry import cap_per_source, parse_landed, select_sources, skip_scraped


@dataclass(frozen=True)
class State:
    """The tables one run reads and the next one starts from."""

    visited: DataFrame
    articles: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    edge_sources: DataFrame
    failures: DataFrame
    feedback: DataFrame
    runs: DataFrame | None = None
    source_runs: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """``source_names(name)`` narrows the sources; ``incremental`` skips those scraped since the last
    completed run; ``dry_run`` ends after the dedup, with its entries marked as visited;
    ``no_filter`` takes every new entry."""

    source_names: DataFrame | None = None
    incremental: bool = False
    dry_run: bool = False
    no_filter: bool = False


@dataclass
class Run:
    """Inputs of a run and, in ``out``, the tables its finished stages have written."""

    state: State
    landed: DataFrame
    sources: DataFrame
    pages: DataFrame
    briefings: DataFrame
    interests: models.Interests
    params: Params
    briefing_date: str
    run_id: str
    now: Column
    options: Options = Options()
    duration_s: float | None = None
    began: float = field(default_factory=time.monotonic)
    out: dict[str, DataFrame] = field(default_factory=dict)

    def seconds(self) -> float:
        return time.monotonic() - self.began if self.duration_s is None else self.duration_s


def fold_feedback(run: Run) -> dict[str, DataFrame]:
    """Graph nodes and feedback rows after reading the forms of unprocessed documents."""
    rows = briefing.feedback_with_articles(
        briefing.unprocessed_briefings(run.briefings, run.state.feedback)
    )
    day = F.datediff("briefing_date", F.lit("1970-01-01").cast("date")).cast("long")
    # the forms are read once; the fold and the feedback table ask for their rows several times
    rows = Scratch(rows.sparkSession, "forms").put(rows)
    ordered = rows.withColumn("seq", day * (1 << 32) + F.col("article_number"))
    nodes = feedback.apply_feedback(run.state.nodes, ordered, run.now)
    taken = rows.select(
        "briefing_date", "article_number", "title", "read", "interest", "quality",
        run.now.alias("processed_at"),
    )
    return {"nodes": nodes, "feedback": run.state.feedback.unionByName(taken)}


def chosen_sources(run: Run) -> DataFrame:
    sources = run.sources
    if run.options.source_names is not None:
        hits = select_sources(sources, run.options.source_names).filter("matched")
        sources = hits.withColumnRenamed("source_name", "name").select(*sources.columns)
    if run.options.incremental and run.state.runs is not None and run.state.source_runs is not None:
        sources = skip_scraped(sources, run.state.source_runs, run.state.runs)
    return sources


def discover(landed: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries of all payloads, capped per source, in a fixed order ``seq``."""
    parsed = cap_per_source(parse_landed(landed), sources, ["feed_pos", "item_pos"])
    return parsed.withColumn("seq", F.col("feed_pos") * (1 << 32) + F.col("item_pos"))


def find_entries(run: Run) -> dict[str, DataFrame]:
    sources = chosen_sources(run)
    entries = Scratch(run.landed.sparkSession, "entries").put(discover(run.landed, sources))  # payloads are parsed once
    counts = (
        entries.groupBy("source_name")
        .agg(F.count(F.lit(1)).alias("articles_found"))
        .join(sources.select(F.col("name").alias("source_name")), "source_name", "right")
        .select("source_name", F.coalesce("articles_found", F.lit(0).cast("long")).alias("articles_found"))
    )
    return {"entries": entries, "per_source": counts}


def find_new(run: Run) -> dict[str, DataFrame]:
    new = select.new_articles_today(run.out["entries"], run.state.visited, run.now, run.params)
    out = {"new": new}
    if run.options.dry_run:
        rows = new.select(
            "url", "title", "source_name", "seq",
            F.lit(None).cast("boolean").alias("passed_relevance"), F.lit(None).cast("int").alias("relevance_score"),
        )
        out["visited"] = upsert.upsert_visited(run.state.visited, rows, run.now)
    return out


def _with_run(failed: DataFrame, run: Run) -> DataFrame:
    return failed.withColumns({"run_id": F.lit(run.run_id), "seq": F.xxhash64("url", "phase")})


def rate(run: Run) -> dict[str, DataFrame]:
    new, params = run.out["new"], run.params
    if run.options.no_filter:
        scored = select.no_filter(new)
        rank = F.row_number().over(Window.orderBy("seq")).cast("int")
        roles = scored.withColumns({"rank": rank, "role": F.lit("passed")})
        failures = run.state.failures
    else:
        scored, failed = models.score_relevance(new, run.interests)
        scored = Scratch(new.sparkSession, "scored").put(scored)  # rated once, asked for several times
        scored = select.split_relevance(scored, select.adaptive_threshold(new, params))
        roles = select.quota_select(scored, params)
        failures = upsert.upsert_failures(run.state.failures, _with_run(failed, run), run.now)
    visits = select.visited_rows(new, scored)
    return {
        "roles": roles,
        "visited": upsert.upsert_visited(run.state.visited, visits, run.now),
        "filter_failures": failures,
    }


def _read(rows: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """Summaries of the rows whose page landed, and failure rows for the others: a page that never
    landed is another failure than one with too little text."""
    # pages are many and large, the rows few: only their pages are looked into, and those once
    scratch = Scratch(rows.sparkSession, "pages")
    wanted = scratch.put(rows.select("url").distinct())
    asked = scratch.put(run.pages.select("url", "html").join(wanted, "url", "left_semi"))
    html = asked.filter(usable_html(F.col("html"))).select(
        "url", extract_body(F.col("html")).alias("body"), F.lit(True).alias("landed")
    )
    fetched = rows.join(html, "url", "left")
    lost = fetched.filter(F.col("landed").isNull()).select(
        "url", "title", "source_name",
        *checks.failure_columns("fetch", "http_error", F.lit("Could not fetch article body after retries")),
    )
    ok, short = checks.body_gate(fetched.filter("landed"))
    read = models.summarize(
        ok.select("url", "seq", "title", "source_name", "body"), run.params, run.now
    )
    return read, lost.unionByName(short)


def _passed(run: Run) -> DataFrame:
    return run.out["roles"].filter("role = 'passed'")


def _reserve(run: Run) -> DataFrame:
    return run.out["roles"].filter("role = 'reserve'")


def read_passed(run: Run) -> dict[str, DataFrame]:
    first, failed = _read(_passed(run), run)
    return {"first": first, "first_failed": failed}


def read_more(run: Run) -> dict[str, DataFrame]:
    first = run.out["first"]
    second, failed = _read(select.reader_backfill(first, _reserve(run), run.params), run)
    summaries = first.unionByName(second)
    failed = _with_run(run.out["first_failed"].unionByName(failed), run)
    return {
        "summaries": summaries,
        "read": select.extend_passed(_passed(run), _reserve(run), summaries),
        "failures": upsert.upsert_failures(run.out["filter_failures"], failed, run.now),
    }


def _relevance(run: Run) -> DataFrame:
    return run.out["read"].select("url", F.col("score").alias("relevance_score"))


def rate_novelty(run: Run) -> dict[str, DataFrame]:
    params = run.params
    nodes, edges = graph.memory_decay(
        run.out["nodes"], run.state.edges, run.now, params.half_life_days, params.prune_below
    )
    unique = select.first_by_url(run.out["summaries"])
    embedded = models.embed(unique)
    occ = graph.occurrences(unique)
    linked = components.connected_components(nodes, edges)
    near = vectors.knn_cosine(
        embedded.select("url", "embedding"), run.state.vectors, params.neighbours
    )
    novelty = vectors.score_novelty(
        unique, near, graph.graph_novelty(unique, occ, nodes, linked), _relevance(run), params
    )
    incoming = upsert.vector_rows(unique, embedded.select("url", "embedding"))
    return {
        "novelty": novelty,
        "vectors": upsert.upsert_vectors(run.state.vectors, incoming),
        "decayed": nodes,
        "kept_edges": edges,
    }


def grow_graph(run: Run) -> dict[str, DataFrame]:
    nodes, edges = run.out["decayed"], run.out["kept_edges"]
    unique = select.first_by_url(run.out["summaries"])
    chosen = select.novelty_select(unique, run.out["novelty"], run.params)
    occ = graph.occurrences(chosen)
    pairs = graph.article_pairs(occ, graph.declared_relationships(chosen))
    return {
        "next_nodes": graph.update_nodes(nodes, occ, run.now),
        "next_edges": graph.update_edges(edges, pairs, run.now),
        "next_sources": graph.update_edge_sources(run.state.edge_sources, pairs),
        "new_concepts": graph.new_concepts(nodes, occ),
        "selection": chosen,
    }


def write_briefing(run: Run) -> dict[str, DataFrame]:
    out, day = run.out, F.lit(run.briefing_date).cast("date")
    chosen, fresh = out["selection"], out["new_concepts"]
    rows = select.assemble_articles(
        chosen.drop("final_score", "is_near_duplicate"), out["novelty"], _relevance(run)
    ).join(out["novelty"].select("url", "final_score"), "url")
    ranked = rows.withColumns(
        {"briefing_date": day, "rank": F.struct(-F.col("final_score"), "seq")}
    )
    articles = select.number_briefing(ranked).select(*run.state.articles.columns)
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "pos", "concept"))), lambda x: x["concept"]
    )
    about = (
        graph.graph_update_stats(out["decayed"], out["kept_edges"], out["next_nodes"], out["next_edges"])
        .withColumns(
            {
                "briefing_date": day,
                "articles_scanned": out["entries"].agg(F.count(F.lit(1))).scalar(),
                "articles_relevant": out["read"].agg(F.count(F.lit(1))).scalar(),
                "duration_s": F.lit(float(run.seconds())),
                # names of at most max_items articles' concepts
                "new_names": fresh.agg(names).scalar(),
            }
        )
    )
    tips = graph.suggest_explorations(out["next_nodes"], out["next_edges"])
    numbered = tips.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("degree")).alias("d"), "topic", "reason"))
        ).alias("t")
    ).select(F.posexplode("t").alias("i", "x")).select(
        day.alias("briefing_date"), (F.col("i") + 1).alias("pos"), "x.topic", "x.reason"
    )
    concepts = fresh.select(
        day.alias("briefing_date"), F.struct("seq", "pos", "concept").alias("pos"), "concept", "title"
    )
    return {
        "md": briefing.render_briefing(about, articles, concepts, numbered),
        "next_articles": upsert.upsert_articles(run.state.articles, articles),
        "briefed": upsert.mark_briefed(out["visited"], chosen),
    }


STEPS: dict[str, Callable[[Run], dict[str, DataFrame]]] = {
    "ingest_feedback": fold_feedback,
    "discover": find_entries,
    "dedup": find_new,
    "filter": rate,
    "swap_to_reader": read_passed,
    "deep_read": read_more,
    "novelty": rate_novelty,
    "graph_update": grow_graph,
    "briefing": write_briefing,
}


def _ends_after(stage: str, run: Run) -> bool:
    """Whether nothing is left to do: the run's funnel says why."""
    if stage == "dedup":
        return run.options.dry_run or run.out["new"].isEmpty()
    if stage == "filter":
        return _passed(run).isEmpty()
    return stage == "deep_read" and run.out["summaries"].isEmpty()


def _next_state(run: Run) -> State:
    out, old = run.out, run.state
    latest = lambda default, *names: next((out[n] for n in names if n in out), default)
    count = lambda name: out[name].agg(F.count(F.lit(1))).scalar() if name in out else F.lit(0).cast("long")
    runs, source_runs = old.runs, old.source_runs
    if runs is not None:
        spark = runs.sparkSession
        added = F.lit(0).cast("long")
        if "next_nodes" in out:
            added = out["next_nodes"].join(out["decayed"], "concept", "left_anti").agg(F.count(F.lit(1))).scalar()
        row = spark.range(1).select(
            F.lit(run.run_id).alias("run_id"), run.now.alias("started_at"),
            (run.now + F.make_dt_interval(secs=F.lit(float(run.seconds())))).alias("completed_at"),
            count("entries").alias("articles_scanned"), count("read" if "read" in out else "roles").alias("articles_relevant"),
            count("summaries").alias("articles_briefed"), added.alias("new_concepts_added"),
        )
        runs = upsert.record_run(runs, row)
    if source_runs is not None:
        source_runs = upsert.record_source_run(source_runs, out["per_source"].withColumn("seq", F.lit(0)), run.now)
    return State(
        visited=latest(old.visited, "briefed", "visited"),
        articles=latest(old.articles, "next_articles"),
        vectors=latest(old.vectors, "vectors"),
        nodes=latest(old.nodes, "next_nodes", "nodes"),
        edges=latest(old.edges, "next_edges"),
        edge_sources=latest(old.edge_sources, "next_sources"),
        failures=latest(old.failures, "failures", "filter_failures"),
        feedback=latest(old.feedback, "feedback"),
        runs=runs,
        source_runs=source_runs,
    )


def run_day(
    state: State,
    landed: DataFrame,
    sources: DataFrame,
    pages: DataFrame,
    briefings: DataFrame,
    interests: models.Interests,
    params: Params,
    store: StageStore,
    *,
    briefing_date: str,
    now: Column,
    options: Options = Options(),
    duration_s: float | None = None,
) -> tuple[State, DataFrame | None, DataFrame]:
    """The next state, the rendered briefing (None if there was nothing to brief) and the funnel.

    ``store`` belongs to one run: stages it holds finished are loaded, the others are computed and
    written. ``duration_s`` is the time to state in the briefing; it is measured if not given.
    """
    run = Run(
        state, landed, sources, pages, briefings, interests, params, briefing_date, store.run_id, now,
        options, duration_s,
    )
    done, current = set(store.finished()), True
    for stage in STAGES:
        current = current and stage in done  # what follows a stage computed anew is computed anew too
        held = store.load_stage(stage) if current else store.write_stage(stage, **STEPS[stage](run))
        run.out.update(held)
        if _ends_after(stage, run):
            break
    empty = run.out["new"].limit(0)
    funnel = stats.run_funnel(
        run.out["entries"], run.out["new"], run.out.get("read", _passed(run) if "roles" in run.out else empty),
        run.out.get("summaries", empty), params, briefed=options.dry_run or "md" in run.out,
    )
    return _next_state(run), run.out.get("md"), funnel
