"""Joining strings that contain each other, through their rarest piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 4
SHARE_ROWS = 4096
PLACES = 2**31


def pieces(c: Column, n: int) -> Column:
    """Distinct substrings of length ``n``."""
    last = F.length(c) - n + 1
    return F.when(
        last >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def contained_pairs(
    inner: DataFrame, outer: DataFrame, *, piece: int = PIECE, share_rows: int = SHARE_ROWS
) -> DataFrame:
    """``(inner, outer)``: strings of ``inner(inner)`` with the strings of ``outer(outer)`` that hold them.

    Both sides are distinct. An inner string waits under the one of its pieces that fewest outer
    strings have, and takes no part when one of its pieces is in none. Outer strings with the same
    piece are cut into shares of about ``share_rows``, so a piece that most strings have is not one
    task's; an inner string meets each share once.
    """
    short = F.length("inner") < piece
    asked = inner.filter(~short).select("inner", F.explode(pieces(F.col("inner"), piece)).alias("piece"))
    wanted = asked.select("piece").distinct()
    held = outer.select("outer", F.explode(pieces(F.col("outer"), piece)).alias("piece")).join(
        wanted, "piece", "left_semi"
    )
    sizes = held.groupBy("piece").agg(F.count(F.lit(1)).alias("held"))
    # the first piece alone rules most strings out before all of them are laid out
    possible = inner.filter(~short).withColumn("piece", F.left("inner", F.lit(piece))).join(
        sizes.select("piece"), "piece", "left_semi"
    )
    # a count and a place in one number, as a least struct would sort all pieces of all strings
    places = F.sequence(F.lit(1), F.length("inner") - piece + 1)
    rarest = (
        possible.select("inner", F.explode(places).alias("place"))
        .withColumn("piece", F.substr("inner", F.col("place"), F.lit(piece)))
        .join(sizes, "piece", "left")
        .groupBy("inner")
        .agg(F.min(F.coalesce("held", F.lit(0)) * PLACES + F.col("place")).alias("at"))
        .filter(F.col("at") >= PLACES)
    )
    shares = F.ceil(F.expr(f"at div {PLACES}") / F.lit(share_rows)).cast("int")
    waiting = rarest.select(
        "inner",
        F.substr("inner", (F.col("at") % PLACES).cast("int"), F.lit(piece)).alias("piece"),
        F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"),
    )
    many = sizes.filter(F.col("held") > share_rows).select(
        "piece", F.ceil(F.col("held") / F.lit(share_rows)).cast("int").alias("shares")
    )
    dealt = held.join(many, "piece", "left").select(
        "piece", "outer", F.pmod(F.xxhash64("outer"), F.coalesce("shares", F.lit(1))).cast("int").alias("share")
    )
    long_hits = waiting.join(dealt, ["piece", "share"]).filter(F.contains("outer", "inner"))
    few = F.concat(*[pieces(F.col("outer"), n) for n in range(1, piece)])
    short_hits = (
        outer.withColumn("inner", F.explode(few)).join(inner.filter(short), "inner", "left_semi")
    )
    return long_hits.select("inner", "outer").unionByName(short_hits.select("inner", "outer"))
