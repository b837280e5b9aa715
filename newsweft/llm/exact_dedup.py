"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary names every digest that more than ``support`` of the rows share. The winners of
those few digests are worked out and verified, broadcast, and settle their rows on the map side; only
the remaining digests, none of them frequent, are shuffled.

Two texts are equal when they are the same after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Of equal texts the row with the most code points stays, then the one with the smallest ``doc_id``.

Null texts count as empty, and all empty texts are equal. A null ``doc_id`` sorts after all others.
Rows that repeat a ``doc_id`` and text count in ``group_size`` and carry the same verdict;
``drop_copies`` keeps one of them; different texts under one ``doc_id`` are different documents. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved

SUPPORT = 0.002  # the summary holds at most 1 / SUPPORT = 500 digests, which bounds what is broadcast


def _digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", _digest(text).alias("text_sha256"), F.length(text).alias("points"))


def _best_first() -> list[Column]:
    return [-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id")]


def heavy_winners(rows: DataFrame, support: float) -> DataFrame:
    """Keeper and size of every frequent digest; candidates that turn out rare are exact here too."""
    found = rows.stat.freqItems(["text_sha256"], support).first()
    heavy = list(found[0]) if found and found[0] else []
    return (
        rows.where(F.col("text_sha256").isin(heavy))
        .groupBy("text_sha256")
        .agg(F.min(F.struct(*_best_first())).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = saved(digests(docs), "digests")
    winners = F.broadcast(saved(heavy_winners(rows, support), "winners"))
    settled = rows.join(winners, "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = rows.join(winners, "text_sha256", "left_anti").withColumns(
        {
            "keep_id": F.first("doc_id").over(group.orderBy(*_best_first())),
            "group_size": F.count(F.lit(1)).over(group),
        }
    )
    return settled.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row of ``docs`` for each group of equal texts (of its keeper's rows the longest text), columns as they were.

    Digests and ids are joined together, so different texts under one ``doc_id``, or under none, all stay.
    """
    keepers = exact_dedup(docs, support).where("kept").groupBy("text_sha256", F.col("doc_id").alias("stays"))
    keepers = saved(keepers.agg(F.count(F.lit(1)).alias("repeats")), "keepers").alias("k")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", _digest(text).alias("digest")).alias("d")
    same = (F.col("d.digest") == F.col("k.text_sha256")) & F.col("d.doc_id").eqNullSafe(F.col("k.stays"))
    kept = rows.join(keepers, same)
    # only rows that repeat an id and a text are told apart, combined on the map side
    longest = F.struct(-F.length(F.coalesce("row.text", F.lit(""))), "row.text")
    repeated = kept.where("repeats > 1").groupBy("digest").agg(F.min_by("row", longest).alias("row"))
    return kept.where("repeats = 1").select("row").unionByName(repeated.select("row")).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
