"""Exact nearest neighbours by cosine similarity, and novelty scores from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsweft.functions import scoring
from newsweft.lineage import Scratch
from newsweft.operators.skew import top_per_group
from newsweft.params import Params

MAX_PIVOTS = 4096
SAMPLE = 4096
CELL_ROWS = 16384
RINGS = 64
BLOCK_BYTES = 1 << 25
PART_ROWS = 65536
MAX_TASKS = 16384
TILE = 256
CHUNK = 4096
PAIRS = 65536
DIGITS = 6
_STEP = 10**DIGITS
_SLACK = 2.0 / _STEP
_FOUND = "query string, url string, similarity double"


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _round(sims: np.ndarray) -> np.ndarray:
    return np.floor(sims * _STEP + 0.5).astype(np.int64)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _touched(angles: np.ndarray, kth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per query and ring: whether a row of ``kth`` similarity can lie there, by the angles to the rings' pivots."""
    reach = np.arccos(np.clip(kth - _SLACK, -1.0, 1.0)) + 1e-7
    return np.maximum(lo - angles, angles - hi) <= reach[:, None]


class _Block:
    """Store rows of one block, ordered by group; of equal vectors the first ``k`` by name.

    Products in single precision, whose error is bounded, rule most rows out; the rest get exact ones.
    """

    def __init__(self, held: list[tuple], groups: np.ndarray, pivots: np.ndarray, k: int) -> None:
        names, unit, group = (np.concatenate(x) for x in zip(*held))
        by_name = np.argsort(names)
        rank = np.empty(len(names), dtype=np.int64)
        rank[by_name] = np.arange(len(names))
        same = pd.Series([unit[i].tobytes() for i in by_name])
        kept = by_name[(same.groupby(same, sort=False).cumcount() < k).to_numpy()]
        kept = kept[np.argsort(group[kept], kind="stable")]
        self.k, self.names, self.unit, self.rank = k, names[kept], unit[kept], rank[kept]
        self.single = self.unit.astype(np.float32)
        self.error = _SLACK + (unit.shape[1] + 8) * 2.0**-23
        present, self.begins = np.unique(group[kept], return_index=True)
        self.ends = np.append(self.begins[1:], len(kept))
        used, self.pivot = np.unique(groups[present, 0].astype(np.int64), return_inverse=True)
        self.pivots, self.lo, self.hi = pivots[used], groups[present, 1], groups[present, 2]

    def _rows(self, q: np.ndarray, least: np.ndarray) -> Iterator[slice | np.ndarray]:
        """The rows of all groups that a query of the tile can reach, in chunks."""
        met = _touched(_angles(q, self.pivots)[:, self.pivot], least, self.lo, self.hi).any(axis=0)
        if met.all():
            yield from (slice(at, min(at + CHUNK, len(self.unit))) for at in range(0, len(self.unit), CHUNK))
        elif met.any():
            rows = np.concatenate([np.arange(a, b) for a, b in zip(self.begins[met], self.ends[met])])
            yield from (rows[at : at + CHUNK] for at in range(0, len(rows), CHUNK))

    def _able(self, single: np.ndarray, rows: slice | np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        products = single @ self.single[rows].T
        able = products >= (least - self.error).astype(np.float32)[:, None]
        if self.k < products.shape[1] and np.count_nonzero(able) > 8 * self.k * len(single):
            kth = np.partition(products, -self.k, axis=1)[:, -self.k]
            able &= products >= (kth - 2 * self.error)[:, None].astype(np.float32)
        return np.nonzero(able)

    def search(self, names: np.ndarray, unit: np.ndarray, kth: np.ndarray) -> Iterator[pd.DataFrame]:
        """The k nearest rows of every query that reach its ``kth`` similarity."""
        for at in range(0, len(names), TILE):
            q, least = unit[at : at + TILE], kth[at : at + TILE].copy()
            single = q.astype(np.float32)
            best = [np.empty(0, dtype=np.int64)] * 3  # query, store row, rounded similarity
            for rows in self._rows(q, least):
                who, col = self._able(single, rows, least)
                if not len(who):
                    continue
                col = col + rows.start if isinstance(rows, slice) else rows[col]
                for i in range(0, len(who), PAIRS):
                    w, c = who[i : i + PAIRS], col[i : i + PAIRS]
                    sims = _round(np.einsum("ij,ij->i", q[w], self.unit[c]))
                    best = self._first([np.concatenate(x) for x in zip(best, (w, c, sims))])
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == self.k)
                ends = np.searchsorted(best[0], full, side="right") - 1
                least[full] = np.maximum(least[full], best[2][ends] / _STEP)
            yield pd.DataFrame({"query": names[at + best[0]], "url": self.names[best[1]], "similarity": best[2] / _STEP})

    def _first(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """The k best of each query, in order."""
        order = np.lexsort((self.rank[found[1]], -found[2], found[0]))
        who = found[0][order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < self.k]
        return [x[order] for x in found]


def _meet(k: int, groups, pivots):
    """Streams the sorted rows of a task: a block is held, its queries pass by in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, block = None, [], None
        for frame in frames:
            for key, part in frame.groupby("task", sort=False):
                if key != task:
                    task, held, block = key, [], None
                stored, asked = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(stored):
                    held.append((stored["url"].to_numpy(), _unit(stored["embedding"]), stored["group"].to_numpy()))
                if len(asked) and (held or block):
                    if held:
                        block, held = _Block(held, groups.value, pivots.value, k), []
                    yield from block.search(asked["url"].to_numpy(), _unit(asked["embedding"]), asked["kth"].to_numpy())

    return run


class VectorCells:
    """A store laid out for exact search, for any size of it and any number of queries.

    Rows go to the nearest of at most ``MAX_PIVOTS`` pivots, whose number grows with the store; a
    pivot's cell is cut into rings by angle, so a group holds about ``cell_rows`` rows. An angle to
    the pivot outside a ring's range by more than a query's reach rules the ring out.

    Groups are bundled into blocks of at most about ``BLOCK_BYTES`` of vectors (a larger group is
    cut into hashed shares), and a query goes once to each block it can reach, however small the
    groups are; there it meets the groups it can reach. A query's reach comes from a fixed sample of
    the store: its k-th best there is no better than its k-th best of all. The sample and the ranges
    of the groups are broadcast; both are bounded by constants.
    """

    def __init__(self, store: DataFrame, cell_rows: int = CELL_ROWS) -> None:
        self.spark = store.sparkSession
        self.scratch = Scratch(self.spark, "neighbours")
        rows = store.filter("embedding is not null").select("url", "embedding")
        drawn = rows.orderBy(F.xxhash64("url"), "url").limit(SAMPLE).select("embedding").collect()
        self.empty = not drawn
        if self.empty:
            return
        sample = _unit([r[0] for r in drawn])
        n = len(drawn) if len(drawn) < SAMPLE else rows.count()
        self.sample = self.spark.sparkContext.broadcast(sample)
        pivots = self.pivots = self.spark.sparkContext.broadcast(
            sample[: min(MAX_PIVOTS, math.ceil(n / cell_rows))]
        )

        @F.pandas_udf("struct<cell:int,angle:double>")
        def assign(embedding: pd.Series) -> pd.DataFrame:
            cell, angle = [], []
            for at in range(0, len(embedding), TILE):
                sims = np.clip(_unit(embedding[at : at + TILE]) @ pivots.value.T, -1.0, 1.0)
                cell.append(sims.argmax(axis=1).astype(np.int32))
                angle.append(np.arccos(sims.max(axis=1)))
            return pd.DataFrame({"cell": np.concatenate(cell), "angle": np.concatenate(angle)})

        placed = self.scratch.put(rows.withColumn("p", assign("embedding")))
        cuts = F.percentile_approx("p.angle", [i / RINGS for i in range(1, RINGS)], 1000)
        per_cell = placed.groupBy("p.cell").agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts"))
        layout, total = [], 0
        for r in sorted(per_cell.collect()):
            rings = max(1, min(RINGS, r["n"] // cell_rows))
            layout.append((r["cell"], total, [r["cuts"][RINGS * i // rings - 1] for i in range(1, rings)]))
            total += rings
        where = F.broadcast(self.spark.createDataFrame(layout, "cell int, first int, cuts array<double>"))
        ring = F.size(F.filter("cuts", lambda c: F.col("p.angle") > c))
        grouped = placed.withColumn("cell", F.col("p.cell")).join(where, "cell").withColumn("group", F.col("first") + ring)
        # one row per pivot and ring at most
        found = grouped.groupBy("group").agg(
            F.first("cell"), F.min("p.angle"), F.max("p.angle"), F.count(F.lit(1))
        ).collect()
        groups = np.array([(0, np.inf, -np.inf)] * total, dtype=np.float64)
        block_rows = max(1, BLOCK_BYTES // (8 * sample.shape[1]))
        blocks, shares, filled = [], [], block_rows
        for group, cell, lo, hi, held in sorted(tuple(r) for r in found):
            groups[group] = cell, lo, hi
            cut = math.ceil(held / block_rows)
            if cut > 1 or filled + held > block_rows:
                first, filled = (blocks[-1][0] + 1 if blocks else 0), 0
            filled = block_rows if cut > 1 else filled + held
            shares.append((group, first, cut))
            blocks.extend((first + i, group) for i in range(cut))
        self.groups = self.spark.sparkContext.broadcast(groups)
        self.owners = self.spark.sparkContext.broadcast(np.array(blocks, dtype=np.int64))
        self.blocks = blocks[-1][0] + 1
        dealt = F.broadcast(self.spark.createDataFrame(shares, "group int, block int, shares int"))
        self.store = grouped.join(dealt, "group").select(
            "url", "embedding", "group",
            (F.col("block") + F.pmod(F.xxhash64("url"), F.col("shares"))).cast("int").alias("block"),
        )

    def reach(self, k: int):
        """Per query: the k-th best similarity of the sample, its nearest pivot, and the blocks within reach."""
        pivots, sample, groups, owners = self.pivots, self.sample, self.groups, self.owners

        @F.pandas_udf("struct<kth:double,near:int,visits:array<int>>")
        def visits(embedding: pd.Series) -> pd.DataFrame:
            block, group = owners.value.T
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            cell, lo, hi = groups.value[group].T
            cell = cell.astype(np.int64)
            kths, near, out = [], [], []
            for at in range(0, len(embedding), TILE):
                q = _unit(embedding[at : at + TILE])
                if len(sample.value) < k:
                    kth = np.full(len(q), -2.0)
                else:
                    kth = _round(np.partition(q @ sample.value.T, -k, axis=1)[:, -k]) / _STEP
                angles = _angles(q, pivots.value)
                met = np.logical_or.reduceat(_touched(angles[:, cell], kth, lo, hi), starts, axis=1)
                kths.extend(kth)
                near.extend(angles.argmin(axis=1))
                out.extend(block[starts][m].astype(np.int32) for m in met)
            return pd.DataFrame({"kth": kths, "near": near, "visits": out})

        return visits

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query, url, similarity)``: the k most similar rows of each query of ``queries(query, embedding)``.

        A block is met in parts, each with some of the queries that visit it: one for every
        ``PART_ROWS`` queries, and enough for all cores.
        """
        if self.empty:
            return self.spark.createDataFrame([], StructType.fromDDL(_FOUND))
        asked = self.scratch.put(queries.withColumn("v", self.reach(k)("embedding")))
        n = asked.count()
        spread = math.ceil(2 * self.spark.sparkContext.defaultParallelism / self.blocks)
        parts = max(1, math.ceil(n / PART_ROWS), min(spread, math.ceil(n / TILE)))
        tasks = min(MAX_TASKS, self.blocks * parts)
        task = F.col("block").cast("long") * parts + F.col("part")
        none = {"kth": F.lit(None).cast("double"), "near": F.lit(0), "kind": F.lit(0)}
        held = self.store.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), **none})
        come = asked.select(
            F.col("query").alias("url"), "embedding", "v.kth", "v.near", F.explode("v.visits").alias("block"),
            F.lit(0).alias("group"), F.lit(1).alias("kind"),
            F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"),
        )
        columns = ["kind", "url", "embedding", "group", "kth", "near", task.alias("task")]
        rows = held.select(*columns).unionByName(come.select(*columns))
        dealt = rows.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions("task", "kind", "near")
        return _keep_best(dealt.mapInPandas(_meet(k, self.groups, self.pivots), _FOUND), k)


def _keep_best(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found, ["query"], [F.desc("similarity"), F.col("url")], k)


def knn_cosine(
    queries: DataFrame, store: DataFrame, k: int = 5, *, exclude_self: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``(query, url, similarity, rank)``: the k most similar store rows of every query.

    Similarities are rounded to six digits; equal ones are ordered by url. ``queries`` and
    ``store`` have unique ``url`` and an ``embedding``; rows without a vector take no part. Several
    searches of one store share their layout through ``VectorCells``.
    """
    ask = queries.select(F.col("url").alias("query"), "embedding").filter("embedding is not null")
    found = VectorCells(store, cell_rows).search(ask, k + 1 if exclude_self else k)
    if exclude_self:
        found = _keep_best(found.filter(F.col("query") != F.col("url")), k)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "url")
    return found.withColumn("rank", F.row_number().over(order))


def s_max(neighbours: DataFrame) -> DataFrame:
    """The highest similarity found for each query."""
    return neighbours.groupBy(F.col("query").alias("url")).agg(F.max("similarity").alias("s_max"))


def score_novelty(
    summaries: DataFrame,
    neighbours: DataFrame,
    graph: DataFrame,
    relevance: DataFrame,
    params: Params,
    *,
    failed: DataFrame | None = None,
) -> DataFrame:
    """Novelty and final score per url.

    ``graph(url, graph_novelty)`` and ``relevance(url, relevance_score)`` are joined by url; a
    missing relevance counts five. Urls in ``failed`` have no vector and score one half.
    """
    df = (
        summaries.select("url", "seq")
        .join(s_max(neighbours), "url", "left")
        .join(graph.select("url", "graph_novelty"), "url", "left")
        .join(relevance.select("url", "relevance_score"), "url", "left")
    )
    if failed is None:
        df = df.withColumn("lost", F.lit(False))
    else:
        lost = failed.select("url").distinct().withColumn("lost", F.lit(True))
        df = df.join(lost, "url", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    half = lambda c: F.when(F.col("lost"), F.lit(0.5)).otherwise(c)
    df = df.select(
        "url",
        "seq",
        half(scoring.vector_novelty(F.col("s_max"), params)).alias("vector_novelty"),
        half(F.coalesce("graph_novelty", F.lit(1.0))).alias("graph_novelty"),
        F.coalesce("relevance_score", F.lit(5)).alias("relevance_score"),
        "lost",
    )
    v, g = F.col("vector_novelty"), F.col("graph_novelty")
    novelty = F.when(F.col("lost"), F.lit(0.5)).otherwise(scoring.novelty_score(v, g, params))
    final = scoring.final_score(novelty, F.col("relevance_score"), params)
    return df.select(
        "url",
        "seq",
        "vector_novelty",
        "graph_novelty",
        scoring.round_half_up(novelty, 4).alias("novelty_score"),
        scoring.round_half_up(final, 4).alias("final_score"),
        "relevance_score",
        scoring.is_near_duplicate(v).alias("is_near_duplicate"),
    )
