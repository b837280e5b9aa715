"""The keyed writes as merges into a table, for formats that have row-level merges.

Each ``merge_*`` says which rows to bring, by which key, and what becomes of matched and unmatched
ones; ``Merge.into`` hands that to the DataFrame merge writer, so only touched files are rewritten.
``write_through`` does so where the table's format can, and otherwise replaces the table by what the
function in ``upsert`` makes of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.lineage import Scratch
from newsweft.operators import upsert


@dataclass(frozen=True)
class Merge:
    """``source`` merged by ``keys``. ``update`` and ``insert`` give the columns to set from ``s`` (the
    source) and ``t`` (the table); an empty dict sets all columns from the source, None leaves out the clause."""

    source: DataFrame
    keys: tuple[str, ...]
    update: Callable[[Callable, Callable], dict[str, Column]] | dict | None
    insert: Callable[[Callable, Callable], dict[str, Column]] | dict | None

    def into(self, table: str) -> None:
        t = lambda c: F.col(f"{table.split('.')[-1]}.{c}")
        s = lambda c: F.col(f"s.{c}")
        on = reduce(lambda a, b: a & b, [t(k) == s(k) for k in self.keys])
        writer = self.source.alias("s").mergeInto(table, on)
        if self.update is not None:
            matched = writer.whenMatched()
            writer = matched.update(self.update(s, t)) if callable(self.update) else matched.updateAll()
        if self.insert is not None:
            missing = writer.whenNotMatched()
            writer = missing.insert(self.insert(s, t)) if callable(self.insert) else missing.insertAll()
        writer.merge()


def merge_visited(incoming: DataFrame, now: Column) -> Merge:
    return Merge(upsert.visits(incoming, now), ("url",), {}, {})


def merge_briefed(urls: DataFrame) -> Merge:
    listed = urls.select("url").distinct()
    return Merge(listed, ("url",), lambda s, t: {"was_briefed": F.lit(True)}, None)


def merge_articles(incoming: DataFrame) -> Merge:
    return Merge(incoming, ("briefing_date", "article_number"), {}, {})


def merge_run(row: DataFrame) -> Merge:
    return Merge(row, ("run_id",), {}, {})


def merge_source_runs(incoming: DataFrame, now: Column) -> Merge:
    return Merge(upsert.source_visits(incoming, now), ("source_name",), {}, {})


def merge_failures(incoming: DataFrame, now: Column) -> Merge:
    """A known failure keeps title and source; each incoming row is one more retry."""
    last = ("error_type", "error_message", "run_id")
    return Merge(
        upsert.failure_changes(incoming),
        ("url", "phase"),
        lambda s, t: {
            **{c: s(f"last.{c}") for c in last}, "failed_at": now, "retry_count": t("retry_count") + s("n"),
        },
        lambda s, t: {
            "url": s("url"), "phase": s("phase"), "title": s("first.title"), "source_name": s("first.source_name"),
            **{c: s(f"last.{c}") for c in last}, "failed_at": now, "retry_count": s("n") - 1,
        },
    )


def merge_feedback(incoming: DataFrame, articles: DataFrame, now: Column) -> Merge:
    """Fields an update leaves empty keep their value."""
    return Merge(
        upsert.feedback_changes(incoming, articles),
        ("briefing_date", "article_number"),
        lambda s, t: {
            "title": F.coalesce(s("article_title"), t("title")),
            "read": F.coalesce(s("new_read"), t("read"), F.lit(False)),
            "interest": F.coalesce(s("new_interest"), t("interest")),
            "quality": F.coalesce(s("new_quality"), t("quality")),
            "processed_at": now,
        },
        lambda s, t: {
            "briefing_date": s("briefing_date"), "article_number": s("article_number"), "title": s("article_title"),
            "read": F.coalesce(s("new_read"), F.lit(False)), "interest": s("new_interest"),
            "quality": s("new_quality"), "processed_at": now,
        },
    )


def merge_vectors(incoming: DataFrame) -> Merge:
    return Merge(upsert.last_per_key(incoming, ["url"]).drop("seq"), ("url",), {}, {})


def write_through(table: str, merge: Merge, otherwise: Callable[[DataFrame], DataFrame]) -> bool:
    """Merge into ``table``, or, if its format has no row-level merges, replace its rows by
    ``otherwise(current)``, which is written aside first as it reads the table. True if merged."""
    try:
        merge.into(table)
        return True
    except PySparkException as refused:
        if not _no_merge(refused):
            raise
    spark = merge.source.sparkSession
    current = spark.table(table)
    scratch = Scratch(spark, "replace")
    scratch.put(otherwise(current).select(*current.columns)).write.insertInto(table, overwrite=True)
    scratch.close()
    return False


def _no_merge(refused: PySparkException) -> bool:
    """Whether the analyzer, before anything ran, said that the table cannot be merged into."""
    return "MERGE INTO TABLE" in str(refused) and (
        isinstance(refused, AnalysisException) or "not supported" in str(refused) or "UNSUPPORTED" in str(refused)
    )
