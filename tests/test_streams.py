"""Streams against batch runs: windows from a table of visits, failures in parts that are replaced alone."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsweft.operators.select import filter_new
from newsweft.operators.upsert import upsert_failures
from newsweft.params import Params
from newsweft.schemas import FAILURES
from newsweft.streaming import visits

ROWS = "url string, ts timestamp, seq long, kind string"


def _ts(c):
    return F.col(c).cast("timestamp")


def test_seeded_stream_equals_batch_runs(spark, tmp_path):
    """Three batches, each of one instant, against the batch anti-join on a table kept up by hand."""
    params = Params(dedup_days=7, briefed_dedup_days=60)
    seen = [("a", "2024-01-01", False), ("b", "2024-01-01", True), ("c", "2023-06-01", True), ("d", None, False), ("gone", "2023-01-01", True)]
    visited = spark.createDataFrame(seen, "url string, first_seen string, was_briefed boolean").withColumn("first_seen", _ts("first_seen"))
    table = visited
    batches = {
        "2024-01-05": [("a", "entry"), ("b", "entry"), ("c", "entry"), ("d", "entry"), ("e", "entry"), ("e", "entry"), ("e", "briefed")],
        "2024-01-10": [("a", "entry"), ("b", "entry"), ("c", "entry"), ("d", "entry"), ("e", "entry"), ("f", "entry")],
        "2024-02-20": [("a", "entry"), ("b", "entry"), ("c", "entry"), ("e", "entry"), ("f", "entry"), ("g", "briefed"), ("g", "entry")],
    }
    want, root, seq = [], str(tmp_path), 0
    for day, events in batches.items():
        rows = [(u, day, (seq := seq + 1), k) for u, k in events]
        frame = spark.createDataFrame(rows, "url string, ts string, seq long, kind string").withColumn("ts", _ts("ts"))
        now = F.lit(day).cast("timestamp")
        fresh = filter_new(frame.where("kind = 'entry'"), table.where("first_seen is not null"), now, params)
        want += [(r.url, r.seq) for r in fresh.collect()]
        began = {r.url: (r.first_seen, r.was_briefed) for r in table.collect()}
        for r in frame.where("kind = 'entry'").collect():
            if (r.url, r.seq) in want:
                began[r.url] = (r.ts, False)
        for r in frame.where("kind = 'briefed'").collect():
            if began.get(r.url, (None,))[0] is not None:
                began[r.url] = (began[r.url][0], True)
        table = spark.createDataFrame([(u, *x) for u, x in began.items()], "url string, first_seen timestamp, was_briefed boolean")
        frame.write.mode("append").parquet(f"{root}/in")
        stream = visits.stream_filter_new(spark.readStream.schema(ROWS).parquet(f"{root}/in"), params, visited)
        stream.writeStream.option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    got = [(r.url, r.seq) for r in spark.read.schema("url string, ts timestamp, seq long").parquet(f"{root}/out").collect()]
    assert sorted(got) == sorted(want) and len(want) < seq


class _Handle:
    """A url's state by hand, with every call to it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.append(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_url_costs_few_calls_and_passes_its_entries_in_chunks(monkeypatch):
    monkeypatch.setattr(visits, "CHUNK", 3)
    day, handle = visits.DAY_US, _Handle()
    windows = visits.VisitWindows(Params(dedup_days=2, briefed_dedup_days=5))
    windows.init(handle)

    def batch(*rows, watermark=0):
        handle.calls.clear()
        given = (Row(url="u", us=us, seq=i, kind=kind) for i, (us, kind) in enumerate(rows))
        return [r.seq for r in windows.handleInputRows(("u",), given, _Watermark(watermark))], list(handle.calls)

    entries = [(10 * day + i, "entry") for i in range(7)]
    assert batch(*entries) == ([[0, 1, 2], [3, 4, 5], [6]], ["update", "register"])
    assert batch((11 * day, "entry")) == ([], [])  # inside the window: nothing to write
    assert batch((13 * day, "entry"), (None, "entry")) == ([[0]], ["update"])  # moves on, keeps its timer
    assert batch((13 * day, "briefed"), (17 * day, "entry")) == ([[1]], ["update"])
    assert batch((20 * day, "briefed")) == ([], ["update"]) and batch((21 * day, "entry")) == ([], [])
    fired = handle.timers.pop()
    assert fired == 15 * visits.DAY_MS  # the window began at the last of the first entries, on day 10
    windows.handleExpiredTimer(("u",), _Watermark(16 * visits.DAY_MS), None)
    assert handle.value is not None and handle.timers == [22 * visits.DAY_MS]
    windows.handleExpiredTimer(("u",), _Watermark(22 * visits.DAY_MS), None)
    assert handle.value is None


def test_windows_that_move_on_outlive_their_first_timer_and_others_go(spark, tmp_path):
    params, root, want, began = Params(dedup_days=1, briefed_dedup_days=2), str(tmp_path), [], {}
    days = {1: "abz", 2: "cz", 3: "az", 4: "cz", 5: "abz", 6: "z", 7: "az", 8: "z"}
    for seq, (day, urls) in enumerate(days.items()):
        frame = spark.createDataFrame([(u, f"2024-01-{day:02d} 06:00:00", seq, "entry") for u in urls], "url string, ts string, seq long, kind string")
        frame.withColumn("ts", _ts("ts")).write.mode("append").parquet(f"{root}/in")
        stream = visits.stream_filter_new(spark.readStream.schema(ROWS).parquet(f"{root}/in"), params)
        stream.writeStream.option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        fresh = [u for u in urls if u not in began or day - began[u] >= 1]
        want += [(u, seq, day) for u in fresh]
        began |= {u: day for u in fresh}
    got = spark.read.schema("url string, ts timestamp, seq long").parquet(f"{root}/out")
    assert sorted((r.url, r.seq, r.ts.day) for r in got.collect()) == sorted(want)
    held = spark.read.format("statestore").option("path", f"{root}/c").option("stateVarName", "window").load()
    assert {r.url for r in held.select("key.url").collect()} == {u for u, day in began.items() if day + 2 > 6}


def _failures(spark, rows):
    full = [(u, p, "t", "s", "timeout", f"m{i}", None, "r", i) for i, (u, p) in enumerate(rows)]
    return spark.createDataFrame(full, FAILURES.replace(", retry_count bigint", "") + ", seq long")


@pytest.fixture
def now():
    return F.lit("2024-03-01").cast("timestamp")


def test_a_batch_of_ten_keys_rewrites_at_most_ten_parts(spark, tmp_path, now):
    root = str(tmp_path / "t")
    table = visits.FailureTable(spark, root, parts=64)
    assert table.read().count() == 0
    first = _failures(spark, [(f"u{i}", "fetch") for i in range(500)])
    table.apply(first, 0, now)
    files = lambda: {p: tuple(sorted(x for x in os.listdir(f"{root}/{p}") if x.endswith(".parquet"))) for p in os.listdir(root) if p.startswith("part=")}
    before = files()
    second = _failures(spark, [(f"u{i % 9}", "fetch") for i in range(30)] + [("new", "fetch")])
    table.apply(second, 1, now)
    after = files()
    assert len(before) == 64 and 0 < sum(before[p] != after[p] for p in before) <= 10
    empty = spark.createDataFrame([], FAILURES)
    want = upsert_failures(upsert_failures(empty, first, now), second, now)
    key = lambda df: sorted(map(tuple, df.select("url", "phase", "error_message", "retry_count").collect()))
    assert key(table.read()) == key(want)
    table.apply(second.limit(0), 2, now)
    assert files() == after


def test_a_replayed_batch_counts_once(spark, tmp_path, now):
    """Also when only some parts had been replaced before the crash."""
    rows = [(f"u{i % 40}", "fetch") for i in range(100)]
    batch, half = _failures(spark, rows), _failures(spark, rows).where("pmod(xxhash64(url, phase), 8) < 4")
    whole, torn = (visits.FailureTable(spark, str(tmp_path / x), parts=8) for x in ("whole", "torn"))
    for table in (whole, torn):
        table.apply(_failures(spark, [("u1", "fetch"), ("u2", "filter")]), 0, now)
    whole.apply(batch, 1, now)
    torn.apply(half, 1, now)
    torn.apply(batch, 1, now)
    torn.apply(batch, 1, now)
    key = lambda t: sorted((r.url, r.phase, r.retry_count) for r in t.read().collect())
    assert key(torn) == key(whole)


def test_the_week_form_passes_a_url_again_once_the_watermark_is_past_its_window(spark, tmp_path):
    root, out = str(tmp_path), []
    for day, urls in (("2024-01-01", "aab"), ("2024-01-05", "abc"), ("2024-01-20", "ac"), ("2024-01-21", "ac")):
        spark.createDataFrame([(u, day) for u in urls], "url string, ts string").withColumn("ts", _ts("ts")).write.mode("append").parquet(f"{root}/in")
        stream = visits.stream_dedup_week(spark.readStream.schema("url string, ts timestamp").parquet(f"{root}/in"))
        stream.writeStream.option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        held = [r.url for r in spark.read.schema("url string").parquet(f"{root}/out").collect()]
        out.append("".join(sorted(held)))
    assert out == ["ab", "abc", "abc", "aabcc"]  # the third batch moves the watermark past the first windows
