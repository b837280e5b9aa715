"""Group operations that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: Column | int, *, spread: int = 64
) -> DataFrame:
    """The first ``limit`` rows of every group in ``order``.

    A literal limit needs one window: Spark cuts each partition to the limit before it shuffles.
    A per-row limit is not cut early, so the rows are first ranked in ``spread`` slices of each
    group and only the slices' winners meet in the final window.
    """
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if isinstance(limit, int):
        return df.withColumn("__rn", final).filter(F.col("__rn") <= limit).drop("__rn")
    slice_ = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread))
    local = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    return (
        df.withColumn("__slice", slice_)
        .withColumn("__rn", local)
        .filter(F.col("__rn") <= limit)
        .withColumn("__rn", final)
        .filter(F.col("__rn") <= limit)
        .drop("__rn", "__slice")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; pre-cut on the map side by Spark."""
    return top_per_group(df, keys, order, 1)


def pairs_within(
    df: DataFrame, group: str, item: str, carry: list[str], *, block_rows: int = 512
) -> DataFrame:
    """Item pairs ``a < b`` of one group, plus both sides' ``carry`` columns.

    ``df`` holds one row per (group, item). A group is cut into hashed blocks of about
    ``block_rows`` items and each pair of blocks is its own join key, so the work of a large
    group is spread over as many tasks as it has block pairs.
    """
    sizes = df.groupBy(group).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("__nb")
    )
    blocked = df.join(sizes, group).withColumn(
        "__blk", F.pmod(F.xxhash64(item), F.col("__nb")).cast("int")
    )
    everyone = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    left = blocked.select(
        group,
        F.col("__blk").alias("__i"),
        everyone.alias("__j"),
        F.col(item).alias("a"),
        *[F.col(c).alias(f"a_{c}") for c in carry],
    )
    right = blocked.select(
        group,
        everyone.alias("__i"),
        F.col("__blk").alias("__j"),
        F.col(item).alias("b"),
        *[F.col(c).alias(f"b_{c}") for c in carry],
    )
    return (
        left.join(right, [group, "__i", "__j"])
        .filter(F.col("a") < F.col("b"))
        .drop("__i", "__j")
    )


LARGE_GROUP = 1_000_000


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], name: str, *, large: int = LARGE_GROUP
) -> DataFrame:
    """Number the rows of every group 1..n in ``order``.

    One window while the largest group is small. Beyond that the rows are range-partitioned by key
    and order and written once; each range is numbered on its own and shifted by the rows that
    earlier ranges hold of the same key.
    """
    biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest <= large:
        return df.withColumn(
            name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")
        )
    from newsweft.lineage import Scratch

    ranged = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("__part", F.spark_partition_id())
    )
    stored = Scratch(df.sparkSession, "numbering").put(ranged)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        stored.groupBy(*keys, "__part")
        .count()
        .withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return (
        stored.withColumn("__local", local)
        .join(shift, [*keys, "__part"])
        .withColumn(name, (F.col("__local") + F.col("__before")).cast("int"))
        .drop("__part", "__local", "__before")
    )
