"""The dedup window and the retry counter on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from newsweft.lineage import exists
from newsweft.operators.upsert import upsert_failures
from newsweft.params import Params
from newsweft.schemas import FAILURES

DAY_MS = 86_400_000
DAY_US = 1000 * DAY_MS
CHUNK = 10_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WINDOW = "first_seen timestamp, was_briefed boolean"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_OUT = StructType(
    [
        StructField("url", StringType()),
        StructField("us", ArrayType(LongType())),
        StructField("seq", ArrayType(LongType())),
    ]
)


def _us(t: datetime) -> int:
    return (t.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


class VisitWindows(StatefulProcessor):
    """Per url: when its window began and whether it was briefed since.

    Within one micro-batch every entry of a url sees the state the batch started with, as a batch
    run would. ``kind`` is ``entry`` for candidates and ``briefed`` for urls put into a briefing.
    With ``dedup_days`` of 0 no window ever ends, as in a batch run; then state is kept for ever.
    A timer drops a window that can hold nothing back any more. A window has one timer; if it has
    moved on by the time that fires, it gets its next one then, not at each move.

    Urls are many and have few rows each, so what a url costs is kept low: rows instead of a data
    frame of each url, times in microseconds, entries that pass in lists of at most ``CHUNK``, and
    no call to the state for what has not changed.
    """

    def __init__(self, params: Params) -> None:
        self.days, self.briefed_days = params.dedup_days, params.briefed_dedup_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", _WINDOW)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["us"] is None:
            return
        held = self._held()
        if held is None or held[0] < initialState["us"]:
            self._keep(held, (initialState["us"], bool(initialState["was_briefed"])), timerValues)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        began, briefed = held or (None, False)
        span = DAY_US * (self.briefed_days if briefed else self.days)
        restart, marked, times, seqs = None, None, [], []
        for row in rows:
            us, kind = row["us"], row["kind"]
            if kind == "entry":
                if began is not None and (self.days <= 0 or us is None or us - span < began):
                    continue
                times.append(us)
                seqs.append(row["seq"])
                if us is not None and (restart is None or us > restart):
                    restart = us
                if len(times) == CHUNK:
                    yield Row(url=key[0], us=times, seq=seqs)
                    times, seqs = [], []
            elif kind == "briefed" and us is not None and (marked is None or us > marked):
                marked = us
        if times:
            yield Row(url=key[0], us=times, seq=seqs)
        if restart is not None:
            began, briefed = restart, False
        if marked is not None and began is not None and marked >= began:
            briefed = True
        if began is not None:
            self._keep(held, (began, briefed), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held is not None and self._ends(held) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._ends(held))
        else:
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _held(self) -> tuple[int, bool] | None:
        window = self.window.get()
        return None if window is None else (_us(window[0]), window[1])

    def _ends(self, window: tuple[int, bool]) -> int:
        return window[0] // 1000 + max(self.days, self.briefed_days) * DAY_MS

    def _keep(self, held: tuple[int, bool] | None, window: tuple[int, bool], timerValues) -> None:
        if window != held:
            self.window.update((_EPOCH + timedelta(microseconds=window[0]), window[1]))
        if held is None and self.days > 0:
            self.handle.registerTimer(max(self._ends(window), timerValues.getCurrentWatermarkInMs() + 1))


def stream_filter_new(rows: DataFrame, params: Params, visited: DataFrame | None = None) -> DataFrame:
    """Entries of a stream ``(url, ts, seq, kind)`` that are outside their url's window.

    ``visited(url, first_seen, was_briefed)``, unique by url, is what was seen before the stream
    began: it becomes the state of the first batch, so the stream goes on where batch runs ended.
    Later starts go on from the checkpoint and must hand over a table of the same schema. State goes
    when the event time has passed the longer window; only rows that late are dropped. Typed state
    with timers needs the RocksDB store, which is set for the session.
    """
    rows.sparkSession.conf.set(STATE_STORE, ROCKS)
    longest = max(params.dedup_days, params.briefed_dedup_days)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    seeded = None if visited is None else visited.select("url", us("first_seen"), "was_briefed").groupBy("url")
    passed = (
        rows.withWatermark("ts", f"{longest} days")
        .select("url", "ts", us("ts"), "seq", "kind")
        .groupBy("url")
        .transformWithState(VisitWindows(params), _OUT, "append", "EventTime", seeded)
    )
    each = passed.select("url", F.explode(F.arrays_zip("us", "seq")).alias("e"))
    return each.select("url", F.timestamp_micros("e.us").alias("ts"), F.col("e.seq").alias("seq"))


def stream_dedup_week(rows: DataFrame, days: int = 7) -> DataFrame:
    """The single-window form: one row of a url until the watermark, ``days`` behind the latest time, has passed its window."""
    return rows.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["url"])


class FailureTable:
    """Failures in hashed parts, of which a micro-batch rewrites those that its keys fall into.

    Each row keeps the batch that changed it last. A batch that is replayed after a crash finds its
    own number on the rows it had reached and leaves them, so every failure counts once even if only
    some parts had been replaced.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark = spark
        self.root = root
        self.parts = parts
        self._schema = f"{FAILURES}, batch bigint, part int"

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("url", "phase"), F.lit(self.parts)).cast("int")

    def _rows(self) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(self.root)

    def read(self) -> DataFrame:
        return self._rows().drop("batch", "part")

    def apply(self, batch: DataFrame, batch_id: int, now: Column) -> None:
        placed = batch.withColumn("part", self._part())
        touched = [r[0] for r in placed.select("part").distinct().collect()]  # as many as parts at most
        if not touched:
            return
        held = self._rows().filter(F.col("part").isin(touched))
        done = held.filter(F.col("batch") >= batch_id).select("url", "phase")
        fresh = batch.join(done, ["url", "phase"], "left_anti")
        changed = fresh.select("url", "phase").distinct().withColumn("__changed", F.lit(True))
        nxt = (
            upsert_failures(held.drop("batch", "part"), fresh, now)
            .join(changed, ["url", "phase"], "left")
            .join(held.select("url", "phase", F.col("batch").alias("__was")), ["url", "phase"], "left")
            .withColumn("batch", F.when(F.col("__changed"), F.lit(batch_id)).otherwise(F.col("__was")).cast("long"))
            .drop("__changed", "__was")
            .withColumn("part", self._part())
        )
        nxt.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "part"
        ).parquet(self.root)


def stream_failures(failures: DataFrame, table: FailureTable, now: Column | None = None):
    """A writer that folds a stream of failures into ``table``; call ``start`` on it."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, F.current_timestamp() if now is None else now)

    return failures.writeStream.foreachBatch(fold)
