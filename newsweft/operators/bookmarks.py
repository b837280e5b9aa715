"""Bookmarks and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.operators.skew import first_per_key


def _same(a: DataFrame, b: DataFrame):
    on = a["briefing_date"] == b["briefing_date"]
    on = on & (a["article_number"] == b["article_number"])
    return on & a["collection_id"].eqNullSafe(b["collection_id"])


def add_bookmarks(bookmarks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add bookmarks that are not there yet; an empty collection counts as one collection."""
    key = ["briefing_date", "article_number", "collection_id"]
    fresh = first_per_key(incoming, key, [F.col("created_at")]).alias("n")
    held = bookmarks.select(*key).alias("h")
    added = fresh.join(held, _same(fresh, held), "left_anti")
    return bookmarks.unionByName(added.select(*bookmarks.columns))


def remove_bookmarks(bookmarks: DataFrame, articles: DataFrame) -> DataFrame:
    """Drop all bookmarks of the given (date, number) rows."""
    key = ["briefing_date", "article_number"]
    return bookmarks.join(articles.select(*key), key, "left_anti").select(*bookmarks.columns)


def list_bookmarks(bookmarks: DataFrame, collection_id: int | None = None) -> DataFrame:
    if collection_id is not None:
        bookmarks = bookmarks.filter(F.col("collection_id") == collection_id)
    return bookmarks.orderBy(F.desc("created_at"))


def list_collections(collections: DataFrame) -> DataFrame:
    return collections.orderBy("name")


def drop_collections(
    collections: DataFrame, bookmarks: DataFrame, dropped: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete collections by id; their bookmarks stay without a collection."""
    gone = dropped.select(F.col("id").alias("collection_id")).distinct().withColumn(
        "__gone", F.lit(True)
    )
    kept = collections.join(gone, F.col("id") == F.col("collection_id"), "left_anti")
    freed = (
        bookmarks.join(gone, "collection_id", "left")
        .withColumn("collection_id", F.when(F.col("__gone").isNull(), F.col("collection_id")))
        .select(*bookmarks.columns)
    )
    return kept, freed
