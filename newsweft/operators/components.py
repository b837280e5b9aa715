"""Connected components and bridges by contraction.

Both shrink the graph round by round with joins and aggregations only; every round is written to
the shared folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.lineage import Scratch


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, smaller end first."""
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge ``(a, b)`` as ``(v, w)`` and ``(w, v)``; a loop appears once per end."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
            F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
        )
    )
    return edges.select(ends.alias("e"), *carry).select("e.v", "e.w", *carry)


def _priority(round_: int, c: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(round_), c).alias("h"), c.alias("id"))


def _hook(edges: DataFrame, round_: int) -> DataFrame:
    """Every vertex points at its neighbour of lowest priority, or at itself."""
    best = both_ways(edges, "ea", "eb").groupBy("v").agg(
        F.min(F.struct(_priority(round_, F.col("w")).alias("p"), "ea", "eb")).alias("m")
    )
    moves = F.col("m.p") < _priority(round_, F.col("v"))
    return best.select(
        "v",
        F.when(moves, F.col("m.p.id")).otherwise(F.col("v")).alias("root"),
        F.when(moves, F.col("m.ea")).alias("ea"),
        F.when(moves, F.col("m.eb")).alias("eb"),
    )


def _flatten(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow the pointers until each leads to a root."""
    while True:
        up = parents.select(F.col("v").alias("root"), F.col("root").alias("above"))
        jumped = scratch.put(
            parents.join(up, "root").select(
                "v",
                F.col("above").alias("root"),
                "ea",
                "eb",
                (F.col("above") != F.col("root")).alias("moved"),
            )
        )
        scratch.drop(parents)
        parents = jumped
        if not jumped.agg(F.bool_or("moved")).first()[0]:
            return parents


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root of every vertex that has an edge, and the edges of a spanning forest.

    In each round every vertex hooks onto its neighbour of lowest random priority and each tree of
    hooks becomes one vertex. At least half of the remaining vertices vanish per round on average.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    left = scratch.put(
        simple_edges(edges).select("a", "b", F.col("a").alias("ea"), F.col("b").alias("eb"))
    )
    maps: list[DataFrame] = []
    while not left.isEmpty():
        parents = _flatten(scratch.put(_hook(left, len(maps))), scratch)
        maps.append(parents)
        of = lambda end: parents.select(F.col("v").alias(end), F.col("root").alias(f"r{end}"))
        shrunk = (
            left.join(of("a"), "a")
            .join(of("b"), "b")
            .filter(F.col("ra") != F.col("rb"))
            .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .agg(F.min(F.struct("ea", "eb")).alias("e"))
            .select("a", "b", "e.ea", "e.eb")
        )
        nxt = scratch.put(shrunk)
        scratch.drop(left)
        left = nxt
    if not maps:
        empty = left.select(F.col("a").alias("v"), F.col("b").alias("root"))
        return empty, left.select(F.col("ea").alias("a"), F.col("eb").alias("b"))
    forest = None
    for m in maps:
        part = m.filter(F.col("ea").isNotNull()).select(F.col("ea").alias("a"), F.col("eb").alias("b"))
        forest = part if forest is None else forest.unionByName(part)
    roots = maps[-1].select("v", "root")
    for m in reversed(maps[:-1]):
        above = roots.select(F.col("v").alias("root"), F.col("root").alias("top"))
        roots = scratch.put(
            m.select("v", "root")
            .join(above, "root", "left")
            .select("v", F.coalesce("top", "root").alias("root"))
        )
    return roots, forest


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(concept, component)``; a component is named by its first concept in sort order."""
    roots, _ = contract(edges)
    labelled = nodes.select("concept").join(
        roots.withColumnRenamed("v", "concept"), "concept", "left"
    ).select("concept", F.coalesce("root", "concept").alias("root"))
    names = labelled.groupBy("root").agg(F.min("concept").alias("component"))
    return labelled.join(names, "root").select("concept", "component")


def _tree_step(tree: DataFrame, round_: int) -> DataFrame:
    """What happens this round to each vertex with one or two tree edges.

    ``rake``: a leaf leaves the tree. ``fold``: a vertex between two others merges into the first;
    no two adjacent vertices fold in one round.
    """
    around = both_ways(tree, "id").groupBy("v").agg(
        F.count(F.lit(1)).alias("deg"),
        F.min(F.struct("w", "id")).alias("n1"),
        F.max(F.struct("w", "id")).alias("n2"),
    )
    deg = lambda name: around.select(F.col("v").alias(f"{name}w"), F.col("deg").alias(f"{name}deg"))
    small = (
        around.filter(F.col("deg") <= 2)
        .select(
            "v", "deg",
            F.col("n1.w").alias("n1w"), F.col("n1.id").alias("n1id"),
            F.col("n2.w").alias("n2w"), F.col("n2.id").alias("n2id"),
        )
        .join(deg("n1"), "n1w")
        .join(deg("n2"), "n2w")
    )
    first = lambda n: (F.col(f"{n}deg") > 2) | (
        _priority(round_, F.col("v")) < _priority(round_, F.col(f"{n}w"))
    )
    rake = (F.col("deg") == 1) & ((F.col("n1deg") > 1) | (F.col("v") < F.col("n1w")))
    fold = (
        (F.col("deg") == 2)
        & (F.col("n1deg") >= 2)
        & (F.col("n2deg") >= 2)
        & first("n1")
        & first("n2")
    )
    return small.withColumn("what", F.when(rake, "rake").when(fold, "fold")).filter(
        F.col("what").isNotNull()
    )


def bridge_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose removal splits a component.

    Edges outside a spanning forest get 64-bit labels; a forest edge is a bridge when the labels
    that leave its subtree cancel out under XOR. The subtree sums come from raking leaves and
    folding chains, which takes a number of rounds logarithmic in the size of the forest.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "bridges")
    every = scratch.put(simple_edges(edges))
    _, forest = contract(every)
    tree = scratch.put(forest.withColumn("id", F.struct("a", "b")))
    others = every.join(tree.select("a", "b"), ["a", "b"], "left_anti")
    labels = both_ways(others.withColumn("x", F.xxhash64("a", "b")), "x")
    held = scratch.put(labels.groupBy("v").agg(F.bit_xor("x").alias("x")))
    values: list[DataFrame] = []
    folds: list[DataFrame] = []
    round_ = 0
    while not tree.isEmpty():
        step = scratch.put(
            _tree_step(tree, round_)
            .join(held, "v", "left")
            .withColumn("x", F.coalesce("x", F.lit(0).cast("long")))
        )
        raked, folded = step.filter("what = 'rake'"), step.filter("what = 'fold'")
        values.append(raked.select(F.col("n1id").alias("id"), "x"))
        folds.append(folded.select(F.col("n1id").alias("id"), F.col("n2id").alias("on"), "x"))
        passed_on = step.select(F.col("n1w").alias("v"), "x")
        kept = held.join(step.select("v"), "v", "left_anti")
        next_held = scratch.put(
            kept.unionByName(passed_on).groupBy("v").agg(F.bit_xor("x").alias("x"))
        )
        moved = folded.select(
            F.col("n2id").alias("id"), F.col("n1w").alias("to_a"), F.col("n2w").alias("to_b")
        )
        next_tree = scratch.put(
            tree.join(step.select(F.col("n1id").alias("id")), "id", "left_anti")
            .join(moved, "id", "left")
            .select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "id")
        )
        scratch.drop(held)
        scratch.drop(tree)
        held, tree = next_held, next_tree
        round_ += 1
    if not values:
        return every.limit(0)
    known = values[-1]
    for value, fold in zip(reversed(values[:-1]), reversed(folds[:-1])):
        settled = fold.join(known.select(F.col("id").alias("on"), F.col("x").alias("y")), "on").select(
            "id", F.col("x").bitwiseXOR(F.col("y")).alias("x")
        )
        known = scratch.put(known.unionByName(value).unionByName(settled))
    return known.filter(F.col("x") == 0).select("id.a", "id.b")
