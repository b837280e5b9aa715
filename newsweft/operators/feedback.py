"""Reader feedback folded into the concept graph, in order, without collecting a concept's history.

One entry changes familiarity by a clamped addition, and clamped additions compose to one clamped
addition. Entries are therefore folded in slices of the sequence, the slices in slices, and the few
remaining steps per concept. The running mean of the ratings is rounded to two digits at every
step: from the 801st rating on one rating moves it by less than half a digit, so later ones leave
it as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.concepts import normalize_concept
from newsweft.functions.scoring import round_half_up
from newsweft.operators.skew import top_per_group

SLICE = 4096
LAST_MOVING_RATING = 801
_ONE = 10_000
_FREE = 10**12


def _shift(add: Column, low: Column, high: Column) -> Column:
    return F.struct(
        add.cast("long").alias("add"), low.cast("long").alias("low"), high.cast("long").alias("high")
    )


def _then(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``: x -> min(high, max(low, x + add))."""
    clamp = lambda x: F.least(F.greatest(x, g["low"]), g["high"])
    return _shift(f["add"] + g["add"], clamp(f["low"] + g["add"]), clamp(f["high"] + g["add"]))


def _identity() -> Column:
    return _shift(F.lit(0), F.lit(-_FREE), F.lit(_FREE))


def _entry_shift(read: Column, interest: Column) -> Column:
    """Effect of one entry in ten-thousandths: reading first, then the rating."""
    up, down, free = F.lit(_ONE), F.lit(0), F.lit(_FREE)
    reading = F.when(read, _shift(F.lit(1500), -free, up)).otherwise(_identity())
    rating = (
        F.when(interest >= 4, _shift(500 * (interest - 3), -free, up))
        .when(interest <= 2, _shift(-500 * (3 - interest), down, free))
        .otherwise(_identity())
    )
    return _then(reading, rating)


def _fold(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "f")))
    return df.groupBy(*keys).agg(
        F.aggregate(ordered, _identity(), lambda acc, x: _then(acc, x["f"])).alias("f")
    )


def familiarity_shift(rows: DataFrame) -> DataFrame:
    """``(concept, f)`` from ``rows(concept, seq, pos, read, interest)``; ``seq`` is unique per entry."""
    steps = rows.select(
        "concept",
        F.struct("seq", "pos").alias("at"),
        F.expr(f"seq div {SLICE}").alias("slice"),
        _entry_shift(F.col("read"), F.col("interest")).alias("f"),
    )
    slices = _fold(steps, ["concept", "slice"], "at").withColumn(
        "part", F.expr(f"slice div {SLICE}")
    )
    parts = _fold(slices, ["concept", "part"], "slice").withColumn(
        "whole", F.expr(f"part div {SLICE}")
    )
    return _fold(_fold(parts, ["concept", "whole"], "part"), ["concept"], "whole")


def rating_mean(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(concept, interest_score)`` after the ratings in ``rows``, from the scores in ``nodes``."""
    rated = rows.filter(F.col("interest").isNotNull()).select("concept", "seq", "pos", "interest")
    first = top_per_group(rated, ["concept"], [F.col("seq"), F.col("pos")], LAST_MOVING_RATING)
    listed = F.array_sort(F.collect_list(F.struct("seq", "pos", "interest")))
    held = first.groupBy("concept").agg(listed.alias("ratings"))
    before = F.coalesce("interest_count", F.lit(0)).cast("double")
    fresh = F.col("interest_score").isNull() | (before <= 0)
    start = F.struct(
        F.when(fresh, F.lit(0.0)).otherwise(F.col("interest_score")).alias("s"),
        F.when(fresh, F.lit(0.0)).otherwise(before).alias("n"),
    )
    step = lambda acc, x: F.struct(
        round_half_up((acc["s"] * acc["n"] + x["interest"]) / (acc["n"] + 1), 2).alias("s"),
        (acc["n"] + 1).alias("n"),
    )
    return held.join(nodes, "concept").select(
        "concept", F.aggregate("ratings", start, step)["s"].alias("interest_score")
    )


def apply_feedback(nodes: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """Nodes after ``feedback(seq, read, interest, concepts)``; unknown concepts are ignored.

    A rating outside 1..5 stops the job: the fold relies on that range, and so does the format.
    """
    rating = F.when(F.col("interest").between(1, 5), F.col("interest")).when(
        F.col("interest").isNotNull(),
        F.raise_error(F.concat(F.lit("rating outside 1..5: "), F.col("interest"))).cast("int"),
    )
    rows = (
        feedback.select(
            "seq",
            F.coalesce("read", F.lit(False)).alias("read"),
            rating.alias("interest"),
            F.posexplode("concepts").alias("pos", "raw"),
        )
        .select("seq", "pos", "read", "interest", normalize_concept(F.col("raw")).alias("concept"))
        .join(nodes.select("concept"), "concept", "left_semi")
    )
    counts = rows.groupBy("concept").agg(
        F.count_if("read").alias("reads"), F.count("interest").alias("ratings")
    )
    base = nodes
    for name, kind in (("interest_score", "double"), ("interest_count", "bigint")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    means = rating_mean(rows, base.select("concept", "interest_score", "interest_count"))
    joined = (
        base.join(counts, "concept", "left")
        .join(familiarity_shift(rows), "concept", "left")
        .join(means.withColumnRenamed("interest_score", "new_score"), "concept", "left")
    )
    rated = F.coalesce(F.col("ratings") > 0, F.lit(False))
    was_read = F.coalesce(F.col("reads") > 0, F.lit(False))
    x = F.coalesce("familiarity", F.lit(0.0)) * _ONE
    moved = F.least(F.col("f.high").cast("double"), F.greatest(F.col("f.low").cast("double"), x + F.col("f.add")))
    familiarity = (
        F.when(rated, F.floor(moved + 0.5) / float(_ONE))
        .when(was_read, moved / float(_ONE))
        .otherwise(F.col("familiarity"))
    )
    out = {
        "familiarity": familiarity,
        "encounter_count": F.col("encounter_count") + F.coalesce("reads", F.lit(0)),
        "last_seen": F.when(was_read, now).otherwise(F.col("last_seen")),
        "interest_score": F.coalesce("new_score", "interest_score"),
        "interest_count": F.when(
            rated, F.coalesce("interest_count", F.lit(0)) + F.col("ratings")
        ).otherwise(F.col("interest_count")),
    }
    return joined.withColumns(out).select(*base.columns)
