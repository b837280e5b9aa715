"""Exact top-k inner products by norm buckets.

Vectors are grouped by length on a geometric grid, and each group is cut into buckets of about
``BUCKET`` rows by a hash, so a length that a third of all vectors share is spread like any other. A
first pass over the bucket of the longest vectors gives each query a score it has to beat. A bucket
whose longest vector cannot reach it is skipped. In the others the local cosine threshold (the score
over query length times bucket length) picks the pruning: a high one restricts the query's largest
coordinates to the interval the angle allows, a low one cuts the bucket at the length still needed.
What survives is verified by exact products. All queries against all rows run as tiles of one bucket
and one slice of query blocks; a tile streams its query blocks past one bucket held in memory.

Components are ``floor(256 * x)`` in double precision; products are exact below 2**53. Vectors that are
null or hold a null or non-finite component take no part, nor do rows without ``vec_id``. Shorter vectors count as
filled up with zeros. The query's own id is no candidate; otherwise every row is one, so a repeated
row can be listed twice. Of rows that repeat a query id one asks. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved

BUCKET = 4096  # rows of a bucket
BLOCK = 256  # queries of a block
BLOCKS_PER_TILE = 64
GRID = math.log(1.02)  # lengths within two per cent share a group: under 1,500 groups up to 2**40
COORDINATES = 3  # how many of a query's coordinates are bounded
STEEP = 0.9  # local cosine threshold from which coordinates prune better than lengths
SLACK = 1e-9  # on all bounds, against rounding

VECTOR = "vec_id long, norm double, cell int, v binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            whole = [np.floor(scale * np.asarray(e, dtype=np.float64)) for e in frame["embedding"]]
            norm = np.array([math.sqrt(float(w @ w)) for w in whole])
            cell = np.where(norm > 0, np.floor(np.log(np.maximum(norm, 0.5)) / GRID), -100)
            yield pd.DataFrame(
                {"vec_id": frame["vec_id"], "norm": norm, "cell": cell.astype(np.int32), "v": [w.tobytes() for w in whole]}
            )

    return vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", x.cast("array<double>").alias("embedding")).mapInPandas(rows, VECTOR)


def _matrix(blobs) -> np.ndarray:
    rows = [np.frombuffer(b, dtype=np.float64) for b in blobs]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Bucket:
    """One bucket in memory, longest vector first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.longest = self.norms[0]

    def best(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best ids and scores among the rows that can reach ``least``."""
        d = min(q.shape[1], self.vectors.shape[1])
        norms = np.sqrt((q * q).sum(axis=1))
        reach = norms * self.longest
        bound = np.where(np.isfinite(least) & (reach > 0), least / np.maximum(reach, 1e-300), -np.inf)
        active = np.flatnonzero(least <= reach + SLACK * (1 + reach))
        if not len(active):
            return
        by_coordinate = np.median(bound[active]) >= STEEP
        if not by_coordinate:  # one product over the longest rows that any of the block's queries needs
            needed = np.where(np.isfinite(least) & (least > 0) & (norms > 0), least / np.maximum(norms, 1e-300), 0)[active]
            rows = int(np.searchsorted(-self.norms, -(needed.min() * (1 - SLACK) - SLACK), side="right"))
            products = q[active][:, :d] @ self.vectors[:rows, :d].T
        for n, i in enumerate(active):
            if by_coordinate:
                at = self._inside(q[i, :d], norms[i], bound[i])
                scores = self.vectors[at, :d] @ q[i, :d]
            else:
                at, scores = slice(0, rows), products[n]
            names = self.ids[at]
            fit = np.flatnonzero((scores >= least[i]) & (names != ids[i]))
            if len(fit) > k:
                kth = np.partition(scores[fit], len(fit) - k)[len(fit) - k]
                fit = fit[scores[fit] >= kth]
            fit = fit[np.lexsort((names[fit], -scores[fit]))[:k]]
            yield int(ids[i]), names[fit], scores[fit]

    def _inside(self, q: np.ndarray, norm: float, bound: float) -> np.ndarray:
        """Rows whose angle to the query, seen along its largest coordinates, can be small enough."""
        spread = math.acos(min(1.0, max(-1.0, bound)))
        at = np.arange(len(self.ids))
        for f in np.argsort(-np.abs(q))[:COORDINATES]:
            angle = math.acos(min(1.0, max(-1.0, q[f] / norm)))
            low, high = math.cos(min(math.pi, angle + spread)) - SLACK, math.cos(max(0.0, angle - spread)) + SLACK
            x = self.unit[at, f]
            at = at[(x >= low) & (x <= high)]
        return at


TILE = "cell int, slice int, part int, kind int, vec_id long, least double, v binary"
FOUND = "query_id long, vec_id long, score long"


def _search(tiles: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0 make a tile's bucket; rows of kind 1 are queries that stream past it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, blobs, bucket = None, [], [], None
        for frame in frames:
            for this, rows in frame.groupby(["cell", "slice", "part"], sort=False):
                if this != key:
                    key, ids, blobs, bucket = this, [], [], None
                mine = rows[rows["kind"] == 0]
                ids.append(mine["vec_id"].to_numpy())
                blobs.extend(mine["v"])
                ask = rows[rows["kind"] == 1]
                if not len(ask) or not blobs:
                    continue
                if bucket is None:
                    bucket = Bucket(np.concatenate(ids), _matrix(blobs))
                for at in range(0, len(ask), BLOCK):
                    block = ask.iloc[at : at + BLOCK]
                    found = list(bucket.best(block["vec_id"].to_numpy(), _matrix(block["v"]), block["least"].to_numpy(), k))
                    if found:
                        yield pd.DataFrame(
                            {
                                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]),
                                "vec_id": np.concatenate([i for _, i, _ in found]),
                                "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
                            }
                        )

    key = ["cell", "slice", "part"]
    return tiles.repartition(*key).sortWithinPartitions(*key, "kind").mapInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks, k: int = 5, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that satisfies the column ``asks``."""
    rows = saved(quantised(vectors), "vectors")
    cells = sorted((r.cell, r.n, r.longest) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect())
    if not cells:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    slices = {c: math.ceil(n / bucket) for c, n, _ in cells}
    queries = saved(rows.where(asks).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("norm").alias("norm")), "queries")
    n_queries = queries.count()
    parts = max(1, math.ceil(n_queries / (BLOCK * BLOCKS_PER_TILE)))

    per_cell = F.create_map(*[F.lit(x) for c in slices for x in (c, slices[c])])
    placed = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.element_at(per_cell, F.col("cell"))).cast("int"))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    stored = placed.select("cell", "slice", every_part, F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("double").alias("least"), "v")
    asking = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int"))

    def against(which: DataFrame, least, places) -> DataFrame:
        place = F.explode(places).alias("p")
        return which.select(place, "part", F.lit(1).alias("kind"), "vec_id", least.alias("least"), "v").select(
            F.col("p.cell").alias("cell"), F.col("p.slice").alias("slice"), "part", "kind", "vec_id", "least", "v"
        )

    # 1. a score to beat, from one bucket of the longest vectors that has enough rows
    seed = max((c for c, n, _ in cells if n > 8 * k), default=max(cells, key=lambda c: c[1])[0])
    here = F.array(F.struct(F.lit(seed).alias("cell"), F.lit(0).alias("slice")))
    first = _search(stored.where((F.col("cell") == seed) & (F.col("slice") == 0)).unionByName(against(asking, F.lit(float("-inf")), here)), k)
    least = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))

    # 2. every bucket that can still reach it
    asking = asking.join(least, asking["vec_id"] == least["query_id"], "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(float("-inf"))
    )
    buckets = F.array(
        *[F.struct(F.lit(c).alias("cell"), F.sequence(F.lit(0), F.lit(slices[c] - 1)).alias("slices"), F.lit(longest).alias("longest")) for c, _, longest in cells]
    )
    near = F.filter(buckets, lambda b: F.col("least") <= F.col("norm") * b["longest"] * (1 + SLACK) + SLACK)
    places = F.flatten(F.transform(near, lambda b: F.transform(b["slices"], lambda s: F.struct(b["cell"].alias("cell"), s.alias("slice")))))
    found = _search(stored.unionByName(against(asking, F.col("least"), places)), k)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
