"""The staged run, keyed writes into tables, documents as files and large JSON documents."""

import json
import os
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsweft.catalog.core import Tables
from newsweft.catalog.model_queries import INTERESTS, daily_inputs
from newsweft.operators import briefing, merge, upsert
from newsweft.operators.documents import DocumentSink, write_documents
from newsweft.params import Params
from newsweft.plans import daily
from newsweft.plans.staging import StageStore
from newsweft.schemas import FAILURES
from newsweft.sources import files
from newsweft.sources.json_elements import json_elements

SF = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


# -- the run -------------------------------------------------------------------------------------


def test_stage_marker_is_whole_and_names_one_try(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "r")
    assert store.resume_from() == "ingest_feedback"
    store.write_stage("ingest_feedback", nodes=spark.range(2))
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.write_stage("discover", entries=spark.range(5), more=broken)
    assert store.finished() == ["ingest_feedback"] and set(store.load()) == {"nodes"}
    store.write_stage("discover", entries=spark.range(4).withColumn("none", F.lit(None).cast("array<int>")))
    assert store.load_stage("discover")["entries"].count() == 4 and store.resume_from() == "dedup"
    store.clear()
    assert store.finished() == []


def test_a_broken_run_goes_on_and_plans_no_stage_twice(spark, tmp_path, monkeypatch):
    t = Tables(spark, SF)
    t.__dict__["documents"] = t.documents.where("doc_id < 40")
    inputs = daily_inputs(t)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    runs = spark.createDataFrame([], "run_id string, started_at timestamp, completed_at timestamp, articles_scanned long, articles_relevant long, articles_briefed long, new_concepts_added long")
    seen = spark.createDataFrame([], "source_name string, last_run_at timestamp, articles_found long")
    state = daily.State(**{**inputs[0].__dict__, "runs": runs, "source_runs": seen})
    go = lambda store: daily.run_day(state, *inputs[1:], INTERESTS, Params(), store, briefing_date="2024-01-31", now=now(), duration_s=0.0)
    whole, md, funnel = go(StageStore(spark, str(tmp_path / "whole"), "day"))

    def lost(run):
        raise RuntimeError("executors are gone")

    # the same run, broken after deep_read: later stages have left tables, but no marker
    steps = dict(daily.STEPS)
    shutil.copytree(tmp_path / "whole", tmp_path / "broken")
    for stage in ("novelty", "graph_update", "briefing"):
        os.remove(tmp_path / "broken" / "run_id=day" / f"stage={stage}" / "_DONE")
    store = StageStore(spark, str(tmp_path / "broken"), "day")
    monkeypatch.setitem(daily.STEPS, "novelty", lost)
    with pytest.raises(RuntimeError):
        go(store)
    assert store.resume_from() == "novelty"
    for stage in store.finished():
        monkeypatch.setitem(daily.STEPS, stage, lost)  # none of these may be planned again
    monkeypatch.setitem(daily.STEPS, "novelty", steps["novelty"])
    again, md2, funnel2 = go(store)
    assert md2.collect() == md.collect() and funnel2.collect() == funnel.collect() and funnel.first().stop_reason is None
    for name in ("visited", "articles", "nodes", "edges", "failures", "runs", "source_runs"):
        rows = lambda s: sorted(map(repr, getattr(s, name).collect()))
        assert rows(again) == rows(whole), name
    row = whole.runs.first()
    assert row.run_id == "day" and row.articles_scanned == funnel.first().scanned and row.articles_briefed == funnel.first().summarised
    assert whole.source_runs.agg(F.sum("articles_found")).first()[0] == row.articles_scanned

    monkeypatch.undo()
    # the next day nothing is new, and sources scraped since the last completed run are skipped
    nxt, text, funnel = daily.run_day(
        whole, *inputs[1:], INTERESTS, Params(), StageStore(spark, str(tmp_path / "next"), "next"),
        briefing_date="2024-02-01", now=now(), options=daily.Options(incremental=True),
    )
    assert text is None and funnel.first().stop_reason.startswith(("All discovered", "No articles discovered"))
    assert nxt.runs.count() == 2 and nxt.articles.count() == whole.articles.count()
    dry, text, funnel = daily.run_day(
        state, *inputs[1:], INTERESTS, Params(), StageStore(spark, str(tmp_path / "dry"), "dry"),
        briefing_date="2024-01-31", now=now(), options=daily.Options(dry_run=True),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert text is None and dry.visited.where("passed_relevance is null and relevance_score is null").count() >= funnel.first().new > 0


def test_lost_pages_fail_otherwise_than_short_ones(spark):
    run = daily.Run(*[None] * 4, spark.createDataFrame([], "x int"), INTERESTS, Params(), "2024-01-31", "r", now())
    body = "<html><article>" + "word. " * 400 + "</article></html>"
    run.pages = spark.createDataFrame([("a", body), ("b", "<html><p>short</p></html>")], "url string, html string")
    rows = spark.createDataFrame([(u, i, u, "s") for i, u in enumerate("abc")], "url string, seq int, title string, source_name string")
    ok, failed = daily._read(rows, run)
    assert [r.url for r in ok.collect()] == ["a"]
    assert {r.url: r.error_type for r in failed.collect()}["c"] == "http_error"
    assert {r.url: r.error_type for r in failed.collect()}.get("b", "parse_error") in ("parse_error", "http_error")


# -- merges --------------------------------------------------------------------------------------


class Recorder:
    """Stands in for the merge writer and keeps what it is told."""

    def __init__(self):
        self.said = []

    def __getattr__(self, name):
        def say(*args):
            self.said.append((name, *args))
            return self

        return say


@pytest.fixture
def recorded(monkeypatch, spark):
    recorder = Recorder()
    monkeypatch.setattr(type(spark.range(1)), "mergeInto", lambda self, table, on: recorder.begin(table, str(on)), raising=False)
    return recorder


def _incoming(spark):
    rows = [("u1", "fetch", "t", "s", "timeout", "m1", None, "r", 1), ("u1", "fetch", "t2", "s2", "http", "m2", None, "r", 2), ("u9", "fetch", "n", "s", "http", "m", None, "r", 3)]
    return spark.createDataFrame(rows, FAILURES.replace(", retry_count bigint", "") + ", seq long")


def test_merge_clauses(spark, recorded):
    names = lambda: [x[0] for x in recorded.said]
    visits = spark.createDataFrame([("u", "t", "s", True, 5, 1)], "url string, title string, source_name string, passed_relevance boolean, relevance_score int, seq long")
    merge.merge_visited(visits, now()).into("cat.db.visited")
    assert names() == ["begin", "whenMatched", "updateAll", "whenNotMatched", "insertAll", "merge"]
    assert recorded.said[0][1] == "cat.db.visited" and "visited.url" in recorded.said[0][2] and "s.url" in recorded.said[0][2]
    recorded.said.clear()
    merge.merge_briefed(visits).into("visited")
    assert names() == ["begin", "whenMatched", "update", "merge"] and set(recorded.said[2][1]) == {"was_briefed"}
    recorded.said.clear()
    merge.merge_failures(_incoming(spark), now()).into("failures")
    updated, inserted = recorded.said[2][1], recorded.said[4][1]
    assert set(updated) == {"error_type", "error_message", "run_id", "failed_at", "retry_count"}
    assert set(inserted) == {c.split()[0] for c in FAILURES.split(", ")}
    assert "failures.retry_count" in str(updated["retry_count"]) and "s.n" in str(updated["retry_count"])
    for built, keys in (
        (merge.merge_articles(visits), 2), (merge.merge_run(visits), 1),
        (merge.merge_source_runs(visits, now()), 1), (merge.merge_vectors(visits), 1),
    ):
        recorded.said.clear()
        built.into("x")
        assert recorded.said[0][2].count("s.") == keys and names()[-1] == "merge"


def test_merge_assignments_equal_the_pure_functions(spark):
    """What the clauses set, applied by a join as a format with merges would, against ``upsert``."""
    old = spark.createDataFrame([("u1", "fetch", "old", "s0", "x", "m", None, "r0", 4), ("u2", "fetch", "k", "s", "x", "m", None, "r0", 0)], FAILURES)
    m = merge.merge_failures(_incoming(spark), now())
    t, s = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"s.{c}"))
    both = old.alias("t").join(m.source.alias("s"), (t("url") == s("url")) & (t("phase") == s("phase")), "full")
    update, insert = m.update(s, t), m.insert(s, t)
    cols = [c.split()[0] for c in FAILURES.split(", ")]
    got = both.select(*[F.when(s("url").isNull(), t(c)).when(t("url").isNull(), insert[c]).otherwise(update.get(c, t(c))).alias(c) for c in cols])
    want = upsert.upsert_failures(old, _incoming(spark), now()).select(*cols)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_parquet_table_is_replaced_instead(spark, tmp_path):
    old = spark.createDataFrame([("u1", "fetch", "old", "s0", "x", "m", None, "r0", 4), ("u2", "fetch", "k", "s", "x", "m", None, "r0", 0)], FAILURES)
    old.write.option("path", str(tmp_path / "t")).format("parquet").mode("overwrite").saveAsTable("merge_fallback")
    want = sorted(map(repr, upsert.upsert_failures(old, _incoming(spark), now()).select(*old.columns).collect()))
    built = merge.merge_failures(_incoming(spark), now())
    merged = merge.write_through("merge_fallback", built, lambda current: upsert.upsert_failures(current, _incoming(spark), now()))
    assert merged is False and sorted(map(repr, spark.table("merge_fallback").collect())) == want
    with pytest.raises(PySparkException):
        merge.write_through("no_such_table", built, lambda current: current)
    spark.sql("DROP TABLE merge_fallback")


# -- documents -----------------------------------------------------------------------------------


def test_documents_are_written_all_or_none(spark, tmp_path):
    root = str(tmp_path / "docs")
    rows = [(f"d{i % 3}/f{i}.md", f"text {i}\né") for i in range(40)] + [("top.md", None)]
    write_documents(spark.createDataFrame(rows, "path string, content string").repartition(4), root)
    found = {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(root) for f in fs}
    assert found == {p: c or "" for p, c in rows}
    failing = spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("new"), "id").alias("path"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise("x").alias("content")
    )
    outside = spark.createDataFrame([("ok.md", "x"), ("../out.md", "x")], "path string, content string")
    for bad in (failing, outside):
        with pytest.raises(Exception):
            write_documents(bad, root)
        assert sum(len(fs) for _, _, fs in os.walk(root)) == len(rows) and not os.path.exists(tmp_path / "out.md")
        assert not [d for d in os.listdir(root) if d.startswith(".writing")]


def test_a_task_that_outlives_the_abort_leaves_nothing(tmp_path):
    sink = DocumentSink({"path": f"file://{tmp_path}"})
    writer = sink.writer(None, False)
    batch = pa.RecordBatch.from_pylist([{"path": "a.md", "content": "x"}])

    def late():
        yield batch
        writer.abort([])
        yield batch

    for rows in (late(), iter([batch])):  # one at work when the abort comes, one that starts after it
        with pytest.raises(OSError):
            writer.write(rows)
    assert os.listdir(tmp_path) == []


def test_many_small_briefings_are_read_by_few_tasks(spark, tmp_path):
    n = 32 * spark.sparkContext.defaultParallelism + 20
    for i in range(n):
        (tmp_path / f"2024-01-{i:04d}.md").write_text("é\n")
    (tmp_path / "2024-02-03.md").write_bytes(b"a\r\n\xef\xbb\xbfb")
    (tmp_path / "other.txt").write_text("x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
    try:
        rows = files.read_briefings(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() < n
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n + 1 and [r.md for r in got if r.briefing_date is not None and r.md != "é\n"] == ["a\r\n\ufeffb"]


def test_empty_briefings_are_read_too(spark, tmp_path):
    (tmp_path / "2024-01-01.md").write_text("x")
    for f in ("2024-01-02.md", "2024-01-03.txt", ".2024-01-04.md", "in/2024-01-05.md", "in/_x/2024-01-06.md"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    got = lambda **k: sorted((str(r.briefing_date), r.md) for r in files.read_briefings(spark, str(tmp_path), **k).collect())
    assert got() == [("2024-01-01", "x"), ("2024-01-02", "")]
    assert got(nested=True) == [*got(), ("2024-01-05", "")]


def test_a_graph_is_read_from_its_files_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"nodes": [{"id": f"n{i}"}], "links": [{"source": f"n{i}", "target": "x"}]}))
    nodes, edges = files.read_graph_json(spark, str(tmp_path))
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("{}")
    assert nodes.count() == 3 and edges.count() == 3


def test_only_pages_of_the_rows_are_looked_into(spark, monkeypatch):
    """Whatever the planner moves below the join would look into every page."""
    looked = lambda c: F.when(F.contains(c, F.lit("unasked")), F.raise_error(F.lit("looked into")).cast("boolean")).otherwise(True)
    monkeypatch.setattr(daily, "usable_html", looked)
    body = " ".join(f"word{i} is here." for i in range(200))
    pages = spark.createDataFrame([("a", f"<article>{body}</article>"), ("b", "<article>unasked</article>"), ("c", "<article>x</article>")], "url string, html string")
    rows = spark.createDataFrame([("a", 1, "A", "s"), ("c", 2, "C", "s"), ("gone", 3, "G", "s")], "url string, seq long, title string, source_name string")
    run = daily.Run(None, None, None, pages, None, INTERESTS, Params(), "2024-01-31", "r", now())
    read, lost = daily._read(rows, run)
    assert [r.url for r in read.collect()] == ["a"] and {r.url for r in lost.collect()} == {"c", "gone"}


def test_headings_are_read_once_a_document(spark):
    df = spark.range(3).selectExpr("id AS briefing_date", "concat('### 1. T', id, '\n## Your Feedback\n- 1: read=yes\n- 2: read=yes') AS md")
    rows = briefing.feedback_with_articles(df)
    assert sorted((r.briefing_date, r.article_number, r.title) for r in rows.collect()) == [(i, n, f"T{i}" if n == 1 else "") for i in range(3) for n in (1, 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "###" not in plan.split("Generate")[0]  # nothing is read again for each row that comes out


# -- large JSON documents ------------------------------------------------------------------------


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_elements_are_found_wherever_ranges_cut(spark, tmp_path, indent, range_bytes):
    rnd = random.Random(6)
    odd = ['"', "\\", "\\\\", "}", "{", "],", '\\"', "é", "😀", "\n", '{"id": "x"}', "a"]
    text = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randrange(12)))
    graphs = []
    for n in (0, 1, 25):
        nodes = [{"id": f"n{i}" + text(), "category": text(), "encounter_count": i} for i in range(n)]
        links = [{"source": f"n{i}", "target": f"n{i + 1}", "source_articles": [text(), text()], "first_seen": "2024-01-02T03:04:05"} for i in range(n)]
        graphs.append({"directed": False, "graph": {}, "note}": text(), "nodes": nodes, "links": links})
        (tmp_path / f"g{n}.json").write_text(json.dumps(graphs[-1], indent=indent, ensure_ascii=n == 1), encoding="utf-8")
    got = sorted(r.element for r in json_elements(spark, str(tmp_path), range_bytes).collect())
    want = [e for g in graphs for k in ("nodes", "links") for e in g[k]]
    canon = lambda rows: sorted(json.dumps(x, sort_keys=True) for x in rows)
    assert canon(map(json.loads, got)) == canon(want)
    nodes, edges = files.read_graph_json(spark, str(tmp_path), range_bytes)
    assert sorted(r.concept for r in nodes.collect()) == sorted(x["id"] for g in graphs for x in g["nodes"])
    assert sorted(tuple(r.source_articles) for r in edges.collect()) == sorted(tuple(x["source_articles"]) for g in graphs for x in g["links"])


def test_a_file_of_many_ranges_is_many_tasks(spark, tmp_path):
    nodes = [{"id": f"node {i}", "encounter_count": i} for i in range(20_000)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": nodes, "links": []}))
    found = json_elements(spark, str(tmp_path / "g.json"), 1 << 16)
    assert found.count() == 20_000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
