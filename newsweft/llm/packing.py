"""Best-fit packing with large-item matching.

Texts become token ids followed by id 0. Documents above the capacity are cut into full pieces, the
first of which may be shorter. Lengths are whole numbers up to the capacity, so the packing itself
needs only how many pieces there are of each length: pieces above a third of the capacity are matched
greedily, the longest with the longest that still fits, at most two to a bin; the smaller ones, longest
first, go where they leave the least room. That plan is a list of bin kinds with their numbers, whose
size depends on the capacity and not on the corpus. Pieces then look up their place by their rank
among the pieces of their length; ranks are counted in hashed slices, so a length that a third of all
pieces share is no bottleneck.

Null and empty texts are the one id 0. Rows that repeat a ``doc_id`` are packed each on its own. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved
from newsweft.llm.tokens import encoder

CAPACITY = 2048
SLICE_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, json: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(json, ranks).encode
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"].array, frame["text"].array):
                ids = (encode(text) if isinstance(text, str) else b"") + bytes(4)
                n = len(ids) // 4
                start, end = 0, n % capacity or min(n, capacity)
                for piece in range(math.ceil(n / capacity)):
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end = end, end + capacity
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Bin kinds as (how many, lengths in the order they lie in the bin)."""
    left = dict(counts)
    kinds: list[list] = []  # [how many, lengths, room]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), None)
            if mate is None:
                many, lengths = left[n], (n,)
            elif mate == n:
                many, lengths = left[n] // 2, (n, n)
            else:
                many, lengths = min(left[n], left[mate]), (n, mate)
            for m in lengths:
                left[m] -= many
            kinds.append([many, lengths, capacity - sum(lengths)])
    by_room: dict[int, list[list]] = {}
    for kind in kinds:
        by_room.setdefault(kind[2], []).append(kind)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((r for r in by_room if r >= n and by_room[r]), default=None)
            if room is None:  # a new bin, opened with as many as go in
                fit = min(capacity // n, left[n])
                many = left[n] // fit
                opened = [many, (n,) * fit, capacity - n * fit]
                left[n] -= many * fit
                by_room.setdefault(opened[2], []).append(opened)
                continue
            kind = by_room[room].pop()
            fit = min(room // n, left[n])
            many = min(kind[0], left[n] // fit)
            if kind[0] > many:
                by_room[room].append([kind[0] - many, kind[1], room])
            filled = [many, kind[1] + (n,) * fit, room - n * fit]
            left[n] -= many * fit
            by_room.setdefault(filled[2], []).append(filled)
    return [(k[0], k[1]) for kinds in by_room.values() for k in kinds]


def _places(kinds: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, first bin, offset), ranks rising; each row's bins follow each other."""
    at: dict[int, list] = {}
    rank: dict[int, int] = {}
    bin_ = 0
    for many, lengths in kinds:
        offset = 0
        for n in lengths:
            at.setdefault(n, []).append((rank.get(n, 0), bin_, offset))
            rank[n] = rank.get(n, 0) + many
            offset += n
        bin_ += many
    return {n: np.array(rows, dtype=np.int64) for n, rows in at.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, json: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, capacity, json, ranks), "pieces")
    total = cut.count()
    slices = max(8, math.ceil(total / SLICE_ROWS))
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = saved(sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(by_length, capacity)))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        sliced.withColumn("nth", F.row_number().over(in_slice))
        .join(counts, ["length", "slice"])
        .withColumn("rank", F.col("nth") - 1 + F.col("before"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(rank), 2), dtype=np.int64)
        lengths, ranks_ = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            table = places.value[int(n)]
            row = table[np.searchsorted(table[:, 0], ranks_[mine], side="right") - 1]
            out[mine, 0], out[mine, 1] = row[:, 1] + ranks_[mine] - row[:, 0], row[:, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", "rank").alias("p")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset"
    )
